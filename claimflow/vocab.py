"""Fixed values of the claims domain.

Everything here is a lookup table or a constant whose exact content decides the results; the
order inside each list matters wherever a hash bucket indexes into it.
"""

# The eight markets, by country code.
MARKETS = {
    "HKG": "Hong Kong",
    "SGP": "Singapore",
    "JPN": "Japan",
    "AUS": "Australia",
    "THA": "Thailand",
    "IDN": "Indonesia",
    "MYS": "Malaysia",
    "PHL": "Philippines",
}
GEO_PREFIX = "country/"

# Claim types each policy type covers, in bucket order.
COVERED_CLAIM_TYPES = {
    "Auto": ["Auto Collision", "Theft", "Liability"],
    "Home": ["Fire", "Property Damage", "Theft", "Natural Disaster"],
    "Health": ["Medical"],
    "Life": ["Medical"],
    "Commercial": ["Fire", "Property Damage", "Liability", "Theft", "Natural Disaster"],
    "Travel": ["Travel Disruption", "Medical"],
}

# Statuses before and after an evaluation, and the decision that leads to each.
OPEN_STATUSES = ["Pending", "Submitted", "Under Review"]
CLOSED_STATUSES = ["Approved", "Denied"]
STATUS_AFTER = {"APPROVE": "Approved", "DENY": "Denied", "REFER": "Under Review"}
STATUS_OTHERWISE = "Under Review"

# Ten surnames per market, in bucket order.
SURNAMES = {
    "Hong Kong": ["Chan", "Wong", "Lam", "Lee", "Cheung", "Ng", "Ho", "Leung", "Tam", "Kwok"],
    "Singapore": ["Tan", "Lim", "Lee", "Ong", "Ng", "Koh", "Goh", "Teo", "Wong", "Chua"],
    "Japan": ["Tanaka", "Suzuki", "Sato", "Watanabe", "Yamamoto", "Nakamura", "Kobayashi", "Ito",
              "Takahashi", "Yamada"],
    "Australia": ["Smith", "Jones", "Williams", "Brown", "Wilson", "Taylor", "Johnson", "White",
                  "Martin", "Anderson"],
    "Thailand": ["Srisuk", "Chaiyasit", "Wongsa", "Rattana", "Suwannarat", "Petchara", "Siriwan",
                 "Thongchai", "Boonmee", "Nantiya"],
    "Indonesia": ["Wijaya", "Sutanto", "Hartono", "Santoso", "Gunawan", "Hidayat", "Setiawan",
                  "Wibowo", "Saputra", "Kurniawan"],
    "Malaysia": ["Abdullah", "Ibrahim", "Ismail", "Ahmad", "Hassan", "Rahman", "Ali", "Karim",
                 "Zainuddin", "Rosli"],
    "Philippines": ["Santos", "Reyes", "Cruz", "Garcia", "Ramos", "Dela Cruz", "Flores", "Torres",
                    "Villanueva", "Aquino"],
}

# Case-insensitive patterns that pick the indicators out of the long time series.
GDP_PATTERN = "%GDP%per capita%PPP%current international%"
PENETRATION_PATTERN = "%Insurance and financial services%commercial service exports%"
DISPLACED_PATTERN = "%Internally displaced%disasters%"
POPULATION_NAME = "Population, total"

# Words a description must not hold, as (rule, claim type, policy type, words).
# A claim type of None means any. The first list is the short check, the second the full one.
DESCRIPTION_RULES = [
    ("home_theft", "Theft", "Home", ["vehicle", "car park"]),
    ("auto_theft", "Theft", "Auto", ["hotel", "burglary", "residence", "retail"]),
    ("auto_liability", "Liability", "Auto", ["commercial", "signage"]),
    ("health_medical", "Medical", "Health", ["vehicle"]),
]
DESCRIPTION_RULES_FULL = [
    ("home_theft", "Theft", "Home", ["vehicle", "car park", "shopping mall"]),
    ("auto_theft", "Theft", "Auto", ["hotel", "burglary", "break-in", "residence", "retail"]),
    ("auto_liability", "Liability", "Auto", ["commercial", "signage", "premise"]),
    ("health_medical", "Medical", "Health", ["vehicle", "collision"]),
    ("home_any", None, "Home", ["commercial", "warehouse", "retail"]),
    ("commercial_any", None, "Commercial", ["residential", "residence", "apartment", "bedroom"]),
]

# Row counts and per-market bounds of the small complete data set.
EXPECTED_ROWS = {
    "raw_customers": 50,
    "raw_policies": 100,
    "raw_claims": 200,
    "claims": 200,
    "country_risk": 8,
    "indicators": 8,
}
CLAIMS_PER_MARKET = (20, 30)

# Search thresholds and the six sample questions.
HIGH_RELEVANCE = 0.65
MEDIUM_RELEVANCE = 0.55
SEARCH_PASS_MARK = 0.5
SEARCH_HITS = 5
SAMPLE_QUESTIONS = [
    "Does home insurance cover typhoon damage in Hong Kong?",
    "What is the deductible for auto collision in Singapore?",
    "Does health insurance cover hospitalization in Japan?",
    "What does travel insurance cover for flight cancellations?",
    "What is the coverage limit for home insurance?",
    "Is earthquake damage covered under commercial policies?",
]

# Our own wording: three descriptions per covered (policy type, claim type), free of the words
# the rules above forbid. The place comes first, then one of the events of the claim type.
DESCRIPTION_PLACES = {
    "Auto": "insured sedan",
    "Home": "family house",
    "Health": "insured patient",
    "Life": "insured person",
    "Commercial": "office building",
    "Travel": "insured traveller",
}
DESCRIPTION_EVENTS = {
    "Auto Collision": ["rear-ended at a junction", "side impact on the highway", "hit a guard rail in rain"],
    "Theft": ["items stolen overnight", "forced entry reported to police", "valuables missing after a public holiday"],
    "Liability": ["third party injury claim", "damage caused to a neighbour", "legal costs of a settled dispute"],
    "Fire": ["kitchen fire with smoke damage", "electrical fault started a fire", "fire spread from next door"],
    "Property Damage": ["burst pipe soaked the floors", "ceiling collapse after leak", "windows broken by debris"],
    "Natural Disaster": ["typhoon tore off roof panels", "flood water rose one metre", "earthquake cracked the walls"],
    "Medical": ["emergency surgery and ward stay", "fracture treated in hospital", "outpatient tests and medication"],
    "Travel Disruption": ["flight cancelled by storm", "missed connection abroad", "luggage lost in transit"],
}
