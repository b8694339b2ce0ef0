"""The registered queries in SQL for DuckDB, written from the definitions, not from the Spark plans."""

from claimflow import vocab
from claimflow.plans import bindings

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(x) for x in items)


def texts(items) -> str:
    return f"[{words(items)}]"


def simple_case(column: str, table: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def bucket(key: str, n) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


# --- bound tables ----------------------------------------------------------------------------------

CUSTOMERS = f"""
raw_customers AS (
  SELECT customer_id, first_name, last_name, country, country || '-' || (k % 5) AS city
  FROM (
    SELECT c_custkey AS k, 'CUS-' || c_custkey AS customer_id,
           split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
           CASE WHEN n_nationkey % 9 < 8 THEN {texts(vocab.MARKETS.values())}[n_nationkey % 9 + 1] ELSE n_name END AS country
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey))
"""

POLICIES = """
raw_policies AS (
  SELECT 'POL-' || c_custkey AS policy_number, 'CUS-' || c_custkey AS customer_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Auto' WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'FURNITURE' THEN 'Health'
              WHEN 'BUILDING' THEN 'Commercial' WHEN 'MACHINERY' THEN 'Travel' END AS policy_type,
         CAST(300000 + 10 * c_acctbal AS DECIMAL(18,2)) AS coverage_limit,
         CAST(500 * (1 + c_custkey % 5) AS DECIMAL(18,2)) AS deductible,
         CAST(1000 + c_custkey % 1000 AS DECIMAL(18,2)) AS premium
  FROM customer)
"""

RAW_CLAIMS = """
raw_claims AS (
  SELECT o_orderkey AS k, 'CLM-' || o_orderkey AS claim_id, 'POL-' || o_custkey AS policy_number,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Medical' WHEN '2-HIGH' THEN 'Fire' WHEN '3-MEDIUM' THEN 'Theft'
              WHEN '4-NOT SPECIFIED' THEN 'Property Damage' WHEN '5-LOW' THEN 'Auto Collision' END AS claim_type,
         CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'O' THEN 'Submitted' WHEN 'F' THEN 'Under Review' END AS status,
         o_orderdate AS filing_date, CAST(o_totalprice AS DECIMAL(18,2)) AS claim_amount,
         CASE o_orderkey % 4 WHEN 0 THEN 'vehicle damaged in car park' WHEN 1 THEN 'hotel burglary'
              WHEN 2 THEN 'commercial signage fell' ELSE 'typhoon damage to residence' END AS description
  FROM orders)
"""

SERIES = """
timeseries AS (
  SELECT 'country/' || ['HKG','SGP','JPN','AUS','THA','IDN','MYS','PHL','USA'][user_id % 9 + 1] AS geo_id,
         event_type AS variable,
         CASE event_type WHEN 'purchase' THEN 'GDP per capita, PPP (current international $)'
              WHEN 'view' THEN 'Insurance and financial services (% of commercial service exports)'
              WHEN 'click' THEN 'Internally displaced persons, new displacement associated with disasters'
              WHEN 'signup' THEN 'Population, total' WHEN 'error' THEN 'Other indicator' END AS variable_name,
         ts AS date,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_type = 'signup' AND user_id % 9 = 7 THEN 0.0 ELSE value END AS value
  FROM events)
"""

MARKET_GEOS = words("country/" + code for code in vocab.MARKETS)
RISK = f"""
newest AS (
  SELECT geo_id, variable_name, date, value FROM timeseries WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY geo_id, variable_name ORDER BY date DESC NULLS FIRST, value DESC) = 1),
pivoted AS (
  SELECT geo_id,
         max(value) FILTER (WHERE variable_name ILIKE {q(vocab.GDP_PATTERN)}) AS gdp,
         max(value) FILTER (WHERE variable_name ILIKE {q(vocab.PENETRATION_PATTERN)}) AS penetration_pct,
         max(value) FILTER (WHERE variable_name ILIKE {q(vocab.DISPLACED_PATTERN)}) AS displaced,
         max(value) FILTER (WHERE variable_name = {q(vocab.POPULATION_NAME)}) AS population
  FROM newest GROUP BY geo_id),
country_risk AS (
  SELECT {simple_case("split_part(geo_id, '/', 2)", vocab.MARKETS)} AS country, split_part(geo_id, '/', 2) AS country_code,
         gdp AS gdp_per_capita, penetration_pct / 100 AS insurance_penetration,
         displaced / nullif(population, 0) AS natural_disaster_exposure, population,
         displaced AS disaster_displaced_persons
  FROM pivoted WHERE geo_id IN ({MARKET_GEOS}))
"""

CLAIMS = """
claims AS (
  SELECT c.k, c.claim_id, c.claim_type, p.policy_type, c.policy_number, c.status, u.country, u.city, u.first_name,
         u.last_name, c.filing_date, c.claim_amount, p.coverage_limit, p.deductible, p.premium,
         CAST(NULL AS VARCHAR) AS ai_decision, CAST(NULL AS VARCHAR) AS ai_reasoning, c.description
  FROM raw_claims c LEFT JOIN raw_policies p USING (policy_number) LEFT JOIN raw_customers u USING (customer_id))
"""

FULL = """
full_claims AS (
  SELECT c.*, r.gdp_per_capita AS country_gdp_per_capita, r.insurance_penetration AS country_insurance_penetration,
         r.natural_disaster_exposure AS country_disaster_exposure, r.population, r.disaster_displaced_persons
  FROM claims c LEFT JOIN country_risk r USING (country))
"""

EVALUATED = """
evaluated AS (
  SELECT * REPLACE (
    CASE k % 5 WHEN 1 THEN 'APPROVE' WHEN 2 THEN 'DENY' WHEN 3 THEN 'REFER' WHEN 4 THEN '  ' END AS ai_decision,
    CASE k % 5
      WHEN 1 THEN '{"decision": "APPROVE", "risk_score": 3, "recommended_payout": 120, "reasoning": "fine ' || claim_id || '"}'
      WHEN 2 THEN 'over the limit: ' || claim_id
      WHEN 3 THEN '{"risk_score": "7"}' END AS ai_reasoning)
  FROM claims)
"""

RESPONSES = r"""
first_responses AS (
  SELECT claim_id, filing_date, k,
         '{"decision": "' || CASE k % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'DENY' ELSE 'REFER' END || '", "risk_score": '
         || (k % 10 + 1) || ', "recommended_payout": ' || (k % 1000) || ', "flags": ["manual"], "reasoning": "case ' || claim_id || '"}' AS body
  FROM raw_claims),
responses AS (
  SELECT claim_id, filing_date AS decided_at,
         CASE k % 6 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
              WHEN 2 THEN '```' || chr(10) || body || chr(10) || '```'
              WHEN 3 THEN 'Here is my answer: ' || body || ' Regards'
              WHEN 4 THEN '  ' || left(body, length(body) - 1)
              ELSE 'I cannot decide on ' || claim_id END AS response
  FROM first_responses
  UNION ALL
  SELECT claim_id, date_trunc('day', filing_date) + INTERVAL 30 DAY,
         '{"decision": "REFER", "risk_score": 5, "recommended_payout": 0, "reasoning": "second look"}'
  FROM first_responses WHERE k % 5 = 0)
"""

# Fences off, then the whole text or else its widest braces as one JSON object.
PARSED = r"""
cleaned AS (
  SELECT claim_id, decided_at,
         CASE WHEN starts_with(bare, '```')
              THEN regexp_replace(regexp_replace(bare, '^```(?:json)?\s*', ''), '\s*```$', '') ELSE bare END AS clean
  FROM (SELECT *, regexp_replace(response, '^\s+|\s+$', '', 'g') AS bare FROM responses)),
spans AS (
  SELECT *, CASE WHEN json_valid(clean) THEN clean ELSE regexp_extract(clean, '(?s)\{.*\}') END AS span FROM cleaned),
read AS (
  SELECT *, CASE WHEN json_valid(span) AND json_type(CASE WHEN json_valid(span) THEN span END) = 'OBJECT' THEN span END AS obj
  FROM spans),
parsed AS (
  SELECT claim_id, decided_at,
         CASE WHEN obj IS NULL THEN 'REFER' ELSE coalesce(obj ->> '$.decision', 'REFER') END AS decision,
         CASE WHEN obj IS NULL THEN '5' ELSE obj ->> '$.risk_score' END AS risk_score,
         CASE WHEN obj IS NULL THEN 0 ELSE TRY_CAST(obj ->> '$.recommended_payout' AS DECIMAL(18,2)) END AS recommended_payout,
         CASE WHEN obj IS NULL THEN clean ELSE obj ->> '$.reasoning' END AS reasoning, obj AS accepted, obj IS NULL AS failed
  FROM read),
last_decisions AS (
  SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY decided_at DESC) = 1)
"""

_COVERED = " OR ".join(
    f"(policy_type = {q(p)} AND claim_type IN ({words(types)}))" for p, types in vocab.COVERED_CLAIM_TYPES.items()
)
_ALLOWED = "CASE policy_type " + " ".join(
    f"WHEN {q(p)} THEN {texts(types)}" for p, types in vocab.COVERED_CLAIM_TYPES.items()
) + " END"
_EVENTS = "CASE claim_type " + " ".join(
    f"WHEN {q(t)} THEN {texts(events)}" for t, events in vocab.DESCRIPTION_EVENTS.items()
) + " END"

RETYPED = f"""
retyped AS (
  SELECT * REPLACE (
    CASE WHEN NOT ({_COVERED}) AND {_ALLOWED} IS NOT NULL
         THEN ({_ALLOWED})[{bucket('claim_id', f'len({_ALLOWED})')} + 1] ELSE claim_type END AS claim_type)
  FROM claims)
"""

JUDGED = f"""
judged AS (
  SELECT *,
    CASE WHEN claim_amount > coverage_limit THEN 'DENY' WHEN NOT ({_COVERED}) THEN 'DENY'
         WHEN claim_amount IS NULL OR coverage_limit IS NULL OR deductible IS NULL OR claim_type IS NULL OR policy_type IS NULL
         THEN 'REFER' ELSE 'APPROVE' END AS decision,
    CASE WHEN claim_amount > coverage_limit THEN 'Claim amount exceeds the coverage limit.'
         WHEN NOT ({_COVERED}) THEN 'Claim type is not covered by the policy type.'
         WHEN claim_amount IS NULL OR coverage_limit IS NULL OR deductible IS NULL OR claim_type IS NULL OR policy_type IS NULL
         THEN 'Claim needs investigation: inputs are missing.' ELSE 'Claim is covered and within the limit.' END AS reasoning,
    greatest(1, least(10, CAST(round(1
      + 6 * least(coalesce(claim_amount::DOUBLE / nullif(coverage_limit::DOUBLE, 0), 1), 1)
      + 3 * least(coalesce(country_disaster_exposure, 0) / 0.05, 1)) AS BIGINT))) AS risk_score
  FROM full_claims),
paid AS (
  SELECT *, CASE WHEN decision = 'APPROVE'
                 THEN CAST(greatest(least(claim_amount, coverage_limit) - deductible, 0) AS DECIMAL(18,2))
                 ELSE CAST(0 AS DECIMAL(18,2)) END AS recommended_payout
  FROM judged),
outcome AS (
  SELECT *, CASE decision WHEN 'APPROVE' THEN 'Approved' WHEN 'DENY' THEN 'Denied' ELSE 'Under Review' END AS next_status,
    '{{"decision":"' || decision || '","risk_score":' || risk_score || ',"recommended_payout":'
      || CAST(recommended_payout AS VARCHAR) || ',"reasoning":"' || reasoning || '"}}' AS json
  FROM paid)
"""

NOTES = r"""
note_texts AS (
  SELECT 'note_' || k || '.txt' AS file_name, claim_id, claim_type, description, policy_number, k, filing_date, claim_amount,
    'FIELD INSPECTION REPORT' || chr(10) || 'Claim Number: ' || claim_id || chr(10)
    || CASE WHEN k % 4 < 2 THEN 'Date of Inspection: ' ELSE 'Date of Report: ' END
    || CASE WHEN k % 2 = 0 THEN strftime(filing_date, '%Y-%m-%d') ELSE strftime(filing_date, '%B %-d, %Y') END || chr(10)
    || CASE WHEN k % 5 = 0 THEN 'Field Adjuster: ' ELSE 'Adjuster: ' END
    || 'Robin ' || policy_number || ' (License #' || k || ')' || chr(10) || chr(10)
    || CASE k % 4 WHEN 0 THEN 'DAMAGE ASSESSMENT:' WHEN 1 THEN 'OBSERVED DAMAGES:' ELSE 'INCIDENT DETAILS:' END || chr(10)
    || description || chr(10) || chr(10) || 'COST BREAKDOWN:' || chr(10)
    || '1. Parts: USD 1,000.50' || chr(10) || '   - Bolts: USD 5' || chr(10) || '- Labor: $' || (k % 100) || chr(10)
    || CASE k % 3 WHEN 0 THEN 'Total Loss Amount: $' || amt WHEN 1 THEN 'Total Claim Amount: USD ' || amt
            ELSE 'Total: SGD 999,999 (USD ' || amt || ')' END || chr(10) || chr(10)
    || CASE k % 3 WHEN 0 THEN 'RECOMMENDATION:' WHEN 1 THEN 'RECOMMENDATIONS:' ELSE 'FINDINGS:' END || chr(10)
    || 'Handle ' || claim_id || ' as ' || claim_type || '.' || chr(10) AS text
  FROM (SELECT *, format('{:,.2f}', claim_amount::DOUBLE) AS amt FROM raw_claims)),
note_parts AS (
  SELECT file_name, text, regexp_extract(text, '(?m)^Claim Number:\s*(\S+)', 1) AS claim_id,
         regexp_extract(text, '(?m)^(?:Field )?Adjuster:\s*([^(\n]+?)\s*\(', 1) AS adjuster_name,
         regexp_extract(text, '(?m)^Date of (?:Inspection|Report):\s*(.+?)\s*$', 1) AS written,
         regexp_extract(text, '(?im)^Total[^:\n]*:\s*(.+)$', 1) AS total,
         regexp_extract(text, '(?s)(?:DAMAGE ASSESSMENT|OBSERVED DAMAGES):\n(.*?)(?:\n\n|\n?$)', 1) AS damage,
         regexp_extract(text, '(?s)(?:RECOMMENDATIONS?|FINDINGS):\n(.*?)(?:\n\n|\n?$)', 1) AS advice
  FROM note_texts),
extracted AS (
  SELECT file_name, claim_id, adjuster_name,
         strftime(coalesce(try_strptime(written, '%Y-%m-%d'), try_strptime(written, '%B %d, %Y')), '%Y-%m-%d') AS inspection_date,
         nullif(damage, '') AS damage_assessment,
         CAST(replace(regexp_extract(total, '(?:USD |^\$)([\d,]+(?:\.\d+)?)', 1), ',', '') AS DECIMAL(18,2))::DOUBLE AS estimated_amount,
         advice AS recommendation
  FROM note_parts)
"""

# Cosine of documents (1 + ln tf) with questions ((1 + ln tf) * ln(1 + N / df)).
_SAMPLE = f"SELECT unnest(range({len(vocab.SAMPLE_QUESTIONS)})) AS query_id, unnest({texts(vocab.SAMPLE_QUESTIONS)}) AS question"
_OPENINGS = "SELECT conv_id AS query_id, arg_min(text, turn) AS question FROM conversations GROUP BY conv_id"
_SEARCH = """
questions AS ({asked}),
doc_terms AS (
  SELECT doc_id, term, 1 + ln(count(*)) AS w
  FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
doc_norms AS (SELECT doc_id, sqrt(list_sum(list(w * w ORDER BY w))) AS norm FROM doc_terms GROUP BY doc_id),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM doc_terms GROUP BY term),
question_terms AS (
  SELECT query_id, term, (1 + ln(count(*))) * any_value(idf) AS w
  FROM (SELECT query_id, unnest(string_split_regex(lower(question), '[^a-z]+')) AS term FROM questions) JOIN idf USING (term)
  GROUP BY ALL),
question_norms AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM question_terms GROUP BY query_id),
scored AS (
  SELECT t.query_id, d.doc_id, list_sum(list(t.w * d.w ORDER BY t.term)) / any_value(n.norm) / any_value(m.norm) AS score
  FROM question_terms t JOIN doc_terms d USING (term) JOIN doc_norms n USING (doc_id) JOIN question_norms m ON m.query_id = t.query_id
  GROUP BY t.query_id, d.doc_id),
ranks AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0),
best AS (
  SELECT d.doc_id, coalesce(b.query_id, 0) AS query_id, coalesce(b.score, 0) AS score
  FROM documents d LEFT JOIN (
    SELECT * FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, query_id) = 1) b USING (doc_id))
"""

SEARCH, ASKED_SEARCH = _SEARCH.replace("{asked}", _SAMPLE), _SEARCH.replace("{asked}", _OPENINGS)



def _gapped(name: str, source: str, key: str, gaps: dict[str, int]) -> str:
    """`source` with NULLs in these columns, as `bindings` puts them."""
    columns = ", ".join(f"CASE WHEN gap_key % {bindings.GAPS_PER} <> {n} THEN {c} END AS {c}" for c, n in gaps.items())
    return f"{name} AS (SELECT * EXCLUDE (gap_key) REPLACE ({columns}) FROM (SELECT *, CAST(substr({key}, 5) AS BIGINT) AS gap_key FROM {source}))"


# What each bound table builds on, in order of definition.
PARTS = {
    "raw_customers": (CUSTOMERS, []),
    "raw_policies": (POLICIES, []),
    "raw_claims": (RAW_CLAIMS, []),
    "timeseries": (SERIES, []),
    "risk": (RISK, ["timeseries"]),
    "claims": (CLAIMS, ["raw_customers", "raw_policies", "raw_claims"]),
    "full_claims": (FULL, ["claims", "risk"]),
    "evaluated": (EVALUATED, ["claims"]),
    "responses": (RESPONSES, ["raw_claims"]),
    "parsed": (PARSED, ["responses"]),
    "retyped": (RETYPED, ["claims"]),
    "judged": (JUDGED, ["full_claims"]),
    "notes": (NOTES, ["raw_claims"]),
    "gapped": (_gapped("gapped", "claims", "claim_id", bindings.CLAIM_GAPS), ["claims"]),
    "gapped_full": (_gapped("gapped_full", "full_claims", "claim_id", bindings.CLAIM_GAPS), ["full_claims"]),
    "gapped_policies": (_gapped("gapped_policies", "raw_policies", "policy_number", bindings.POLICY_GAPS), ["raw_policies"]),
    "search": (SEARCH, []),
    "asked_search": (ASKED_SEARCH, []),
}


def oracle(name: str, needs: str, body: str) -> None:
    wanted: set[str] = set()

    def need(part: str) -> None:
        for other in PARTS[part][1]:
            need(other)
        wanted.add(part)

    for part in needs.split():
        need(part)
    defined = [PARTS[p][0].strip() for p in PARTS if p in wanted]
    ORACLES[name] = (f"WITH {','.join(defined)}\n" if defined else "") + body.strip()


_LIKE = {
    full: [
        (
            name,
            "("
            + (f"claim_type = {q(ct)} AND " if ct else "")
            + f"policy_type = {q(pt)} AND ("
            + " OR ".join(f"contains(lower(description), {q(w)})" for w in ws)
            + "))",
        )
        for name, ct, pt, ws in rules
    ]
    for full, rules in ((False, vocab.DESCRIPTION_RULES), (True, vocab.DESCRIPTION_RULES_FULL))
}
_ANY_SHORT = " OR ".join(cond for _, cond in _LIKE[False])

_ALL_CLAIM_COLUMNS = """claim_id, claim_type, policy_type, policy_number, status, country, city, first_name, last_name,
  filing_date, claim_amount::DOUBLE AS claim_amount, coverage_limit::DOUBLE AS coverage_limit,
  deductible::DOUBLE AS deductible, premium::DOUBLE AS premium, ai_decision, ai_reasoning,
  country_gdp_per_capita, country_insurance_penetration, country_disaster_exposure"""

# --- sources and sinks -----------------------------------------------------------------------------

oracle("ingest_claims_stream", "raw_claims",
       "SELECT claim_id, policy_number, claim_type, status, filing_date, claim_amount::DOUBLE AS claim_amount, description FROM raw_claims")
oracle("read_notes", "raw_claims", """
SELECT claim_type AS kind, CAST(k // 5000 AS BIGINT) AS part, true AS named, count(*) AS lines,
       md5(string_agg(claim_id || ' ' || description || chr(10), '' ORDER BY k)) AS text_md5
FROM raw_claims GROUP BY ALL""")
_POLICY_TEXT = """'Policy ' || policy_number || ' is a ' || policy_type || ' policy. Coverage limit $'
  || format('{:,.0f}', coverage_limit::DOUBLE) || ', deductible $' || format('{:,.0f}', deductible::DOUBLE)
  || ', annual premium $' || format('{:,.0f}', premium::DOUBLE) || '.'"""
oracle("read_policy_docs", "raw_policies", f"""
SELECT policy_type AS kind, CAST(CAST(substr(policy_number, 5) AS BIGINT) // 5000 AS BIGINT) AS part, true AS named,
       count(*) AS lines, md5(string_agg({_POLICY_TEXT} || chr(10), '' ORDER BY CAST(substr(policy_number, 5) AS BIGINT))) AS text_md5
FROM raw_policies GROUP BY ALL""")
oracle("materialize_risk", "risk", "SELECT * FROM country_risk")
_APPLIED = """
SELECT c.claim_id, coalesce(CASE d.decision WHEN 'APPROVE' THEN 'Approved' WHEN 'DENY' THEN 'Denied' WHEN 'REFER' THEN 'Under Review' END,
                            CASE WHEN d.decision IS NULL THEN c.status ELSE 'Under Review' END) AS status,
       d.decision AS ai_decision,
       CASE WHEN d.accepted IS NOT NULL THEN d.accepted ELSE '{"decision":"' || d.decision || '","risk_score":"' || d.risk_score || '","recommended_payout":'
         || CAST(d.recommended_payout AS DECIMAL(18,2)) || ',"reasoning":"' || replace(d.reasoning, '"', '\\"') || '"}' END AS ai_reasoning,
       c.claim_amount::DOUBLE AS claim_amount
FROM claims c LEFT JOIN last_decisions d USING (claim_id)"""
oracle("apply_decisions", "claims parsed", _APPLIED)
oracle("write_back_buckets", "claims parsed", _APPLIED)
oracle("apply_decisions_bucketed", "claims parsed", _APPLIED)
oracle("write_back_versions", "claims parsed", f"""
SELECT c.claim_id, c.status AS old_status, c.ai_decision AS old_decision, a.status AS new_status, a.ai_decision AS new_decision
FROM claims c JOIN ({_APPLIED}) a USING (claim_id)
WHERE c.status IS DISTINCT FROM a.status OR c.ai_decision IS DISTINCT FROM a.ai_decision""")
oracle("claim_headline", "gapped", """
SELECT claim_id, coalesce('$' || format('{:,.0f}', claim_amount::DOUBLE), 'N/A') AS "Claim Amount",
       coalesce('$' || format('{:,.0f}', coverage_limit::DOUBLE), 'N/A') AS "Coverage Limit",
       coalesce('$' || format('{:,.0f}', deductible::DOUBLE), 'N/A') AS "Deductible", coalesce(status, 'N/A') AS "Status"
FROM gapped""")
oracle("export_csv", "claims", """
SELECT claim_id, claim_type, country, city, claim_amount::DOUBLE AS claim_amount, description FROM claims WHERE claim_amount > 250000""")
oracle("scan_claims", "full_claims", f"SELECT {_ALL_CLAIM_COLUMNS.replace(' premium::DOUBLE AS premium,', '')}, description FROM full_claims")
oracle("scan_timeseries", "timeseries", f"""
SELECT geo_id, variable_name, date, value FROM timeseries WHERE geo_id IN ({MARKET_GEOS}) AND value IS NOT NULL""")
oracle("dataset_claims", "full_claims", f"SELECT {_ALL_CLAIM_COLUMNS} FROM full_claims")
oracle("dataset_risk", "risk", "SELECT * FROM country_risk")
oracle("dataset_notes", "notes", "SELECT * FROM extracted")


def _pick(items, key: str) -> str:
    return f"{texts(items)}[{bucket(key, len(list(items)))} + 1]"


def _seeded(salt: str, key: str = "s") -> str:
    return f"{key} || '/{salt}'"


_GEN_COUNTRY = _pick(vocab.MARKETS.values(), _seeded("country"))
_GEN_POLICY = _pick(vocab.COVERED_CLAIM_TYPES, _seeded("policy"))
_POOL = "CASE country " + " ".join(f"WHEN {q(c)} THEN {texts(p)}" for c, p in vocab.SURNAMES.items()) + " END"
oracle("generate_customers", "", f"""
SELECT 'CUS-' || s AS customer_id, {_pick(["Alex", "Kim", "Sam", "Robin", "Jamie", "Lee", "Noor", "Dana"], _seeded("first"))} AS first_name,
       ({_POOL})[{bucket(_seeded("last"), 10)} + 1] AS last_name, country,
       country || ' City ' || ({bucket(_seeded("city"), 5)} + 1) AS city
FROM (SELECT s, {_GEN_COUNTRY} AS country FROM (SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer))""")
oracle("generate_policies", "", f"""
SELECT 'POL-' || s AS policy_number, 'CUS-' || s AS customer_id, {_GEN_POLICY} AS policy_type,
       CAST(50000 + 1000 * {bucket(_seeded("limit"), 450)} AS DOUBLE) AS coverage_limit,
       CAST(500 * (1 + {bucket(_seeded("deductible"), 6)}) AS DOUBLE) AS deductible,
       CAST(400 + 10 * {bucket(_seeded("premium"), 300)} AS DOUBLE) AS premium
FROM (SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer)""")
oracle("generate_claims", "", f"""
SELECT 'CLM-' || s AS claim_id, 'POL-' || s AS policy_number, claim_type, {_pick(vocab.OPEN_STATUSES, _seeded("status"))} AS status,
       TIMESTAMP '2025-01-01' + to_days(CAST({bucket(_seeded("filed"), 365)} AS INTEGER)) AS filing_date,
       CAST(500 + 25 * {bucket(_seeded("amount"), 20000)} AS DOUBLE) AS claim_amount,
       {simple_case("policy_type", vocab.DESCRIPTION_PLACES)} || ': '
         || ({_EVENTS})[{bucket(_seeded("event"), f"len({_EVENTS})")} + 1] AS description
FROM (SELECT s, policy_type, ({_ALLOWED})[{bucket(_seeded("type"), f"len({_ALLOWED})")} + 1] AS claim_type
      FROM (SELECT s, {_GEN_POLICY} AS policy_type FROM (SELECT CAST(o_orderkey AS VARCHAR) AS s FROM orders)))""")
_CHECK_NAMES = ["claim_type", *(name for name, _ in _LIKE[False]), "description"]
oracle("generated_rule_breaks", "",
       "SELECT unnest(" + texts(_CHECK_NAMES) + ") AS check_name, CAST(0 AS BIGINT) AS violations")

# --- projections, filters, predicates --------------------------------------------------------------

_ONE_CLAIM = "SELECT claim_id, status, claim_amount::DOUBLE AS claim_amount FROM claims WHERE claim_id = 'CLM-7'"
oracle("filter_claim_by_id", "claims", _ONE_CLAIM)
oracle("stored_claim_by_id", "claims", _ONE_CLAIM)
oracle("filter_pending", "claims", "SELECT claim_id, country, claim_amount::DOUBLE AS claim_amount FROM claims WHERE status = 'Pending'")
oracle("filter_in_markets", "timeseries", f"SELECT geo_id, variable, date FROM timeseries WHERE geo_id IN ({MARKET_GEOS})")
oracle("geo_to_country", "timeseries",
       f"""SELECT geo_id, date, {simple_case("split_part(geo_id, '/', 2)", vocab.MARKETS)} AS country FROM timeseries""")
_SCALED = """SELECT country, country_code, round(insurance_penetration * 100, 1) AS ins_pct, round(gdp_per_capita, 0) AS gdp,
  round(natural_disaster_exposure * 100, 1) AS disaster_pct, round(population / 1000000, 1) AS pop_m FROM country_risk"""
oracle("scale_rates", "risk", f"SELECT * EXCLUDE (country_code) FROM ({_SCALED})")
oracle("exposure_ratio", "risk", "SELECT geo_id, displaced / nullif(population, 0) AS exposure FROM pivoted")
oracle("coalesce_exposure", "risk", f"""
SELECT s.country, coalesce(s.disaster_pct, 0) AS disaster_pct, coalesce(r.disaster_displaced_persons, 0) AS displaced
FROM ({_SCALED}) s JOIN country_risk r USING (country)""")
oracle("decision_to_status", "evaluated", """
SELECT claim_id, CASE ai_decision WHEN 'APPROVE' THEN 'Approved' WHEN 'DENY' THEN 'Denied' ELSE 'Under Review' END AS new_status FROM evaluated""")
oracle("risk_band", "parsed", """
SELECT claim_id, score AS risk_score, points, CASE WHEN points <= 3 THEN 'Low' WHEN points <= 6 THEN 'Medium' WHEN points > 6 THEN 'High' END AS band,
       points * 10 AS pct
FROM (SELECT *, CAST(trunc(TRY_CAST(score AS DOUBLE)) AS BIGINT) AS points
      FROM (SELECT claim_id, CASE WHEN failed THEN NULL ELSE risk_score END AS score FROM parsed))""")
_RELEVANCE = "CASE WHEN score > 0.65 THEN 'High' WHEN score > 0.55 THEN 'Medium' ELSE 'Low' END AS relevance"
oracle("relevance_band", "search", f"SELECT doc_id, round(score, 6) AS score, {_RELEVANCE.replace('score', 'best.score')} FROM best")
oracle("claim_labels", "gapped", """
SELECT claim_id, claim_id || ' — ' || coalesce(claim_type, 'None') || ' | ' || coalesce(country, 'None') || ' | ' || coalesce(status, 'None') AS label
FROM gapped""")
oracle("claim_detail_unpivot", "gapped", """
SELECT claim_id, 'Policy' AS field, policy_number AS value FROM gapped
UNION ALL SELECT claim_id, 'Claim Type', claim_type FROM gapped
UNION ALL SELECT claim_id, 'Policy Type', policy_type FROM gapped
UNION ALL SELECT claim_id, 'Location', coalesce(city, 'None') || ', ' || coalesce(country, 'None') FROM gapped
UNION ALL SELECT claim_id, 'Filing Date', strftime(filing_date, '%Y-%m-%d %H:%M:%S') FROM gapped""")
_MISMATCH = f"SELECT claim_id, claim_type, policy_type FROM claims WHERE NOT ({_COVERED})"
oracle("claim_type_mismatch", "claims", _MISMATCH)
oracle("description_violations", "claims", f"SELECT claim_id, claim_type, policy_type, description FROM claims WHERE {_ANY_SHORT}")
oracle("description_violations_full", "claims", " UNION ALL ".join(
    f"SELECT claim_id, claim_type, policy_type, {q(name)} AS rule FROM claims WHERE {cond}" for name, cond in _LIKE[True]))
oracle("unevaluated_claims", "evaluated",
       "SELECT claim_id, ai_decision FROM evaluated WHERE ai_decision IS NULL OR trim(ai_decision) = ''")


def _na(value: str, text: str) -> str:
    return f"CASE WHEN {value} <> 0 THEN {text} ELSE 'N/A' END"


oracle("market_context", "full_claims", f"""
SELECT claim_id, country,
  {_na("country_gdp_per_capita", "'$' || format('{:,.0f}', country_gdp_per_capita)")} AS gdp_per_capita,
  {_na("country_insurance_penetration", "format('{:,.1f}%', country_insurance_penetration * 100)")} AS penetration,
  {_na("country_disaster_exposure", "format('{:,.1f}%', country_disaster_exposure * 100)")} AS exposure,
  {_na("population", "format('{:,.0f}', population)")} AS population_text,
  {_na("disaster_displaced_persons", "format('{:,.0f}', disaster_displaced_persons)")} AS displaced_text,
  coalesce(population <> 0, false) OR coalesce(disaster_displaced_persons <> 0, false) AS shows_population
FROM full_claims""")
oracle("procedure_context", "full_claims", """
SELECT claim_id, round(coalesce(country_gdp_per_capita, 0), 6) AS gdp,
       round(coalesce(country_insurance_penetration, 0) * 100, 6) AS penetration_pct,
       round(coalesce(country_disaster_exposure, 0) * 100, 6) AS exposure_pct
FROM full_claims""")
oracle("render_prompts", "gapped_full", """
SELECT claim_id, concat_ws(chr(10),
  'Assess this insurance claim and answer with one JSON object.',
  'Claim: ' || claim_id || ', status ' || coalesce(status, 'None'),
  'Type: ' || coalesce(claim_type, 'None') || ', policy ' || coalesce(policy_type, 'None'),
  'Amount: ' || coalesce('$' || format('{:,.0f}', claim_amount::DOUBLE), 'None')
    || ', coverage ' || coalesce('$' || format('{:,.0f}', coverage_limit::DOUBLE), 'None')
    || ', deductible ' || coalesce('$' || format('{:,.0f}', deductible::DOUBLE), 'None'),
  'Place: ' || coalesce(city, 'None') || ', ' || coalesce(country, 'None'),
  'Claimant: ' || coalesce(first_name, 'None') || ' ' || coalesce(last_name, 'None'),
  'Incident: ' || coalesce(description, 'None'),
  'GDP per capita: $' || format('{:,.0f}', coalesce(country_gdp_per_capita, 0)),
  'Insurance penetration: ' || format('{:,.2f}%', coalesce(country_insurance_penetration, 0) * 100),
  'Disaster exposure: ' || format('{:,.2f}%', coalesce(country_disaster_exposure, 0) * 100),
  'Deny above the coverage limit or when the policy does not cover the claim type.',
  'Approve a reasonable claim within limits; refer one that needs investigation.',
  'Weigh the country figures in the risk score.',
  'Answer keys: decision (APPROVE, DENY or REFER), risk_score (1-10), recommended_payout, reasoning.') AS prompt
FROM gapped_full""")
oracle("display_projection", "risk", f"""
SELECT country AS "Country", format('{{:,.1f}}%', ins_pct) AS "Ins %", '$' || format('{{:,.0f}}', gdp) AS "GDP/Cap",
       format('{{:,.1f}}%', coalesce(disaster_pct, 0)) AS "Disaster %", format('{{:,.1f}}', pop_m) AS "Pop (M)"
FROM ({_SCALED})""")
oracle("indicators_display", "risk", """
SELECT country AS "Country", country_code AS "Code", format('{:,.1f}%', insurance_penetration * 100) AS "Insurance %",
       '$' || format('{:,.0f}', gdp_per_capita) AS "GDP/Capita",
       format('{:,.1f}%', coalesce(natural_disaster_exposure * 100, 0)) AS "Disaster %"
FROM country_risk""")
oracle("risk_detail_display", "risk", """
SELECT country AS "Country", country_code AS "Code", '$' || format('{:,.0f}', gdp_per_capita) AS "GDP/Cap",
       format('{:,.1f}%', insurance_penetration * 100) AS "Ins Pen",
       format('{:,.1f}%', coalesce(natural_disaster_exposure, 0) * 100) AS "Disaster Exp",
       format('{:,.0f}', population) AS "Population", format('{:,.0f}', coalesce(disaster_displaced_persons, 0)) AS "Displaced"
FROM country_risk""")
oracle("top_claims_display", "claims", """
SELECT claim_id AS "Claim", claim_type AS "Type", country AS "Country", city AS "City", '$' || format('{:,.0f}', claim_amount::DOUBLE) AS "Amount"
FROM claims ORDER BY claim_amount DESC, claim_id LIMIT 10""")
_KPIS = """
SELECT count(*) AS total_claims, CAST(round(sum(claim_amount), 0) AS DOUBLE) AS total_amount,
       round(CAST(sum(claim_amount) AS DOUBLE) / count(claim_amount), 0) AS avg_amount, count(DISTINCT country) AS countries,
       count(ai_decision) AS evaluated, count(*) FILTER (WHERE ai_decision = 'APPROVE') AS approved,
       count(*) FILTER (WHERE ai_decision = 'DENY') AS denied, count(*) FILTER (WHERE ai_decision = 'REFER') AS referred
FROM evaluated"""
oracle("kpi_display", "evaluated", f"""
SELECT format('{{:,}}', total_claims) AS "Total Claims", '$' || format('{{:,.0f}}', total_amount) AS "Total Claimed",
       '$' || format('{{:,.0f}}', avg_amount) AS "Avg Claim", CAST(countries AS VARCHAR) AS "Markets",
       evaluated || ' / ' || total_claims AS "Evaluated", format('{{:,}}', approved) AS "Approved",
       format('{{:,}}', denied) AS "Denied", format('{{:,}}', referred) AS "Referred"
FROM ({_KPIS})""")

# --- joins -----------------------------------------------------------------------------------------

oracle("claims_with_risk", "full_claims",
       "SELECT claim_id, country, claim_amount::DOUBLE AS claim_amount, population, disaster_displaced_persons FROM full_claims")
oracle("load_claims", "full_claims", f"""
SELECT {_ALL_CLAIM_COLUMNS.replace(' premium::DOUBLE AS premium,', '')}, description, population, disaster_displaced_persons
FROM full_claims ORDER BY claim_id""")
oracle("build_curated_claims", "full_claims", f"SELECT {_ALL_CLAIM_COLUMNS}, description FROM full_claims")
oracle("decisions_onto_claims", "parsed",
       "SELECT claim_id, status, decision AS new_decision FROM raw_claims LEFT JOIN last_decisions USING (claim_id)")
oracle("mismatch_anti_join", "claims", _MISMATCH)
_BY_NAME = f"SELECT *, ({_POOL})[{bucket('claim_id', 10)} + 1] AS surname FROM claims"
oracle("names_by_country", "claims", f"SELECT claim_id, country, surname FROM ({_BY_NAME})")
oracle("query_doc_join", "search", "SELECT doc_id, query_id, round(score, 6) AS score FROM best")

# --- aggregations ----------------------------------------------------------------------------------

oracle("kpi_rollup", "evaluated", _KPIS)
oracle("evaluation_progress", "evaluated", f"""
SELECT evaluated, total_claims, evaluated / total_claims AS progress, evaluated * 100 // total_claims AS percent
FROM ({_KPIS}) WHERE total_claims > 0""")
for _name, _column in (("claims_by_type", "claim_type"), ("claims_by_status", "status"),
                       ("claims_by_country", "country"), ("count_by_policy_type", "policy_type")):
    oracle(_name, "claims", f"SELECT {_column}, count(*) AS cnt FROM claims GROUP BY {_column} ORDER BY cnt DESC, {_column}")
oracle("claim_ids_by_type", "claims", "SELECT claim_type, count(claim_id) AS claims FROM claims GROUP BY 1")
oracle("claim_ids_by_status", "claims", "SELECT status, count(claim_id) AS claims FROM claims GROUP BY 1")
oracle("amount_by_country", "claims", "SELECT country, sum(claim_amount)::DOUBLE AS total_amount FROM claims GROUP BY 1")
oracle("bi_kpis", "claims", """
SELECT count(DISTINCT claim_id) AS distinct_claims, sum(claim_amount)::DOUBLE AS total_claimed,
       round(sum(claim_amount)::DOUBLE / count(claim_amount), 2) AS average_claim FROM claims""")
oracle("top_claims_grouped", "claims", """
SELECT claim_id, claim_type, country, status, sum(claim_amount)::DOUBLE AS claim_amount FROM claims GROUP BY ALL ORDER BY claim_amount DESC, claim_id""")
oracle("gdp_by_country", "risk", "SELECT country, avg(gdp_per_capita) AS avg_gdp FROM country_risk GROUP BY 1")
oracle("penetration_by_country", "risk", "SELECT country, avg(insurance_penetration) AS avg_penetration FROM country_risk GROUP BY 1")
oracle("exposure_by_country", "risk", "SELECT country, avg(natural_disaster_exposure) AS avg_exposure FROM country_risk GROUP BY 1")
oracle("country_risk_detail", "risk", """
SELECT country, country_code, avg(gdp_per_capita) AS gdp_per_capita, avg(insurance_penetration) AS insurance_penetration,
       avg(natural_disaster_exposure) AS natural_disaster_exposure, sum(population) AS population
FROM country_risk GROUP BY ALL""")
oracle("risk_pivot", "risk", "SELECT * FROM pivoted")
oracle("violation_counts", "claims", " UNION ALL ".join(
    f"SELECT {q(name)} AS check_name, count(*) FILTER (WHERE {cond}) AS violations FROM claims"
    for name, cond in [("claim_type", f"NOT ({_COVERED})"), *_LIKE[False], ("description", _ANY_SHORT)]))
oracle("avg_amount_nat_disaster_by_country", "retyped", """
SELECT country, round(sum(claim_amount)::DOUBLE / count(*), 2) AS avg_amount FROM retyped WHERE claim_type = 'Natural Disaster' GROUP BY 1""")
oracle("city_most_medical", "claims", """
SELECT city, count(*) AS cnt FROM claims WHERE claim_type = 'Medical' GROUP BY 1 ORDER BY cnt DESC, city LIMIT 1""")
oracle("pending_count", "claims", "SELECT count(*) FILTER (WHERE status = 'Pending') AS pending FROM claims")
oracle("country_highest_total", "claims", """
SELECT country, sum(claim_amount)::DOUBLE AS total_amount FROM claims GROUP BY 1 ORDER BY total_amount DESC, country LIMIT 1""")
_SHARE = "SELECT country, round(100.0 * count(*) FILTER (WHERE claim_type = 'Medical') / count(*), 4) AS share_pct FROM claims"
oracle("type_share_by_country", "claims", f"{_SHARE} GROUP BY 1")
oracle("type_share_in_country", "claims", f"{_SHARE} WHERE country = 'Singapore' GROUP BY 1")
oracle("premium_vs_claim_by_country", "claims", """
SELECT country, round(sum(premium)::DOUBLE / count(premium), 2) AS avg_premium,
       round(sum(claim_amount)::DOUBLE / count(claim_amount), 2) AS avg_claim FROM claims GROUP BY 1""")
oracle("semantic_query", "full_claims", """
SELECT country, policy_type, sum(claim_amount)::DOUBLE AS sum_claim_amount,
       round(sum(deductible)::DOUBLE / count(deductible), 2) AS average_deductible,
       round(sum(coverage_limit)::DOUBLE / count(coverage_limit), 2) AS average_coverage_limit,
       sum(premium)::DOUBLE AS sum_premium, round(avg(country_gdp_per_capita), 2) AS average_country_gdp_per_capita,
       count(claim_id) AS count_claim_id, count(DISTINCT city) AS distinct_count_city
FROM full_claims WHERE status IN ('Pending', 'Submitted') GROUP BY ALL""")

# --- windows, sorts, limits, set operations --------------------------------------------------------

oracle("latest_value", "risk", f"SELECT geo_id, variable_name, date, value FROM newest WHERE geo_id IN ({MARKET_GEOS})")
oracle("ranked_hits", "search", "SELECT query_id, rank, doc_id FROM ranks WHERE rank <= 5")
oracle("claims_ordered", "claims", "SELECT claim_id, status, claim_amount::DOUBLE AS claim_amount FROM claims ORDER BY claim_id")
oracle("top10_claims", "claims", """
SELECT claim_id, claim_type, country, city, claim_amount::DOUBLE AS claim_amount FROM claims ORDER BY claim_amount DESC, claim_id LIMIT 10""")
oracle("risk_profile", "risk", f"""
SELECT country, ins_pct, gdp, coalesce(disaster_pct, 0) AS disaster_pct, pop_m FROM ({_SCALED}) ORDER BY gdp DESC NULLS FIRST, country""")
oracle("indicators_view", "risk", """
SELECT country, country_code, insurance_penetration * 100 AS ins_pct, gdp_per_capita AS gdp,
       coalesce(natural_disaster_exposure * 100, 0) AS disaster_pct
FROM country_risk ORDER BY gdp DESC NULLS FIRST, country""")
oracle("risk_by_population", "risk", """
SELECT country, country_code, gdp_per_capita, insurance_penetration, coalesce(natural_disaster_exposure, 0) AS disaster_exp,
       population, coalesce(disaster_displaced_persons, 0) AS displaced
FROM country_risk ORDER BY population DESC NULLS FIRST, country""")
oracle("search_topk", "search", "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranks WHERE rank <= 3")
oracle("row_count_gate", "claims risk", "SELECT tbl, cnt, expected, cnt = expected AS passed FROM (" + " UNION ALL ".join(
    f"SELECT {q(t)} AS tbl, (SELECT count(*) FROM {'country_risk' if t == 'indicators' else t}) AS cnt, CAST({n} AS BIGINT) AS expected"
    for t, n in vocab.EXPECTED_ROWS.items()) + ")")

# --- text, decisions, search -----------------------------------------------------------------------

oracle("extract_notes", "notes", "SELECT * FROM extracted")
oracle("itemized_totals", "notes", """
SELECT file_name, CASE WHEN k % 3 = 2 THEN 999999.0 ELSE claim_amount::DOUBLE END AS stated_total, 1000.5::DOUBLE + k % 100 AS itemized_total
FROM note_texts""")
oracle("parse_decisions", "parsed", """
SELECT claim_id, decided_at, decision, risk_score, recommended_payout::DOUBLE AS recommended_payout, reasoning, accepted FROM parsed""")
oracle("parse_decisions_strict", "parsed", """
SELECT claim_id, decided_at, CASE WHEN failed THEN 'ERROR' ELSE decision END AS decision,
       CASE WHEN failed THEN NULL ELSE risk_score END AS risk_score,
       CASE WHEN failed THEN NULL ELSE recommended_payout::DOUBLE END AS recommended_payout, reasoning, accepted FROM parsed""")
oracle("previous_evaluation", "evaluated", """
SELECT claim_id, coalesce(obj ->> '$.decision', ai_decision) AS decision, coalesce(obj ->> '$.risk_score', 'N/A') AS risk_score,
       coalesce(obj ->> '$.recommended_payout', '0') AS recommended_payout,
       coalesce(obj ->> '$.reasoning', ai_reasoning, 'No reasoning provided') AS reasoning
FROM (SELECT *, CASE WHEN json_valid(ai_reasoning) THEN ai_reasoning END AS obj FROM evaluated
      WHERE ai_decision IS NOT NULL AND trim(ai_decision) <> '')""")
oracle("evaluate_rules", "judged", "SELECT claim_id, decision, reasoning FROM judged")
oracle("recommended_payout", "judged", "SELECT claim_id, recommended_payout::DOUBLE AS recommended_payout FROM paid")
oracle("risk_score", "judged", "SELECT claim_id, risk_score FROM judged")
oracle("batch_evaluate_pending", "judged", """
SELECT claim_id, CASE WHEN status = 'Pending' THEN next_status ELSE status END AS status,
       CASE WHEN status = 'Pending' THEN decision END AS ai_decision, CASE WHEN status = 'Pending' THEN json END AS ai_reasoning,
       claim_amount::DOUBLE AS claim_amount FROM outcome""")
oracle("evaluate_claim", "judged", """
SELECT claim_id, decision, risk_score, recommended_payout::DOUBLE AS recommended_payout, reasoning, json AS result
FROM outcome WHERE claim_id = 'CLM-7'""")
oracle("evaluation_display", "judged", """
SELECT claim_id, decision, 'Claim status updated: ' || status || ' → ' || next_status AS banner,
       risk_score || '/10 — ' || CASE WHEN risk_score <= 3 THEN 'Low' WHEN risk_score <= 6 THEN 'Medium' ELSE 'High' END || ' Risk' AS risk_label,
       '$' || format('{:,.0f}', recommended_payout::DOUBLE) AS payout, reasoning
FROM outcome""")
oracle("status_transitions", "judged", """
SELECT claim_id, status AS old_status, next_status AS new_status, 'None' AS old_decision, decision AS new_decision, risk_score,
       CASE WHEN risk_score <= 3 THEN 'Low' WHEN risk_score <= 6 THEN 'Medium' ELSE 'High' END AS risk_band
FROM outcome WHERE status = 'Pending'""")
_GAPPED_POLICY_TEXT = """'Policy ' || policy_number || ' is a ' || coalesce(policy_type, 'None') || ' policy. Coverage limit $'
  || coalesce(format('{:,.0f}', coverage_limit::DOUBLE), 'None') || ', deductible $' || coalesce(format('{:,.0f}', deductible::DOUBLE), 'None')
  || ', annual premium $' || coalesce(format('{:,.0f}', premium::DOUBLE), 'None') || '.'"""
oracle("build_policy_text", "gapped_policies", f"SELECT policy_number, policy_type, {_GAPPED_POLICY_TEXT} AS search_text FROM gapped_policies")
oracle("search_vectors", "", """
WITH probes AS (
  SELECT q AS query_id, list_transform(range(64), lambda i: cos((q + 1) * (i + 1))) AS probe FROM range(5) t(q)),
scored AS (
  SELECT query_id, vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], probe) AS score
  FROM probes, embeddings)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY scored.score DESC, doc_id) AS rank
FROM scored QUALIFY rank <= 5""")
ORACLES["search_vectors_clustered"] = ORACLES["search_vectors"]
oracle("search_text", "search", f"SELECT query_id, doc_id, round(score, 6) AS score, rank, {_RELEVANCE.replace('score', 'ranks.score')} FROM ranks WHERE rank <= 5")
PARTS["policy_docs"] = (f"""
policy_docs AS (SELECT policy_number AS doc_id, policy_type AS lang, {_POLICY_TEXT} AS text FROM raw_policies)""", ["raw_policies"])
PARTS["policy_hits"] = (SEARCH.replace("FROM documents", "FROM policy_docs"), ["policy_docs"])
oracle("policy_search", "policy_hits", """
SELECT query_id, rank, doc_id AS policy_number, lang AS policy_type, text AS search_text, round(score, 6) AS score
FROM ranks JOIN policy_docs USING (doc_id) WHERE rank <= 5""")
oracle("search_text_indexed", "search", ORACLES["search_text"].partition("SELECT query_id, doc_id, round")[1] + ORACLES["search_text"].rpartition("SELECT query_id, doc_id, round")[2])
oracle("question_table_search", "asked_search", "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranks WHERE rank <= 5")
oracle("assemble_context", "search", """
SELECT query_id, string_agg('[Document ' || doc_id || ' — ' || lang || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
       count(*) AS documents
FROM ranks JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""")
oracle("search_display", "search", f"""
SELECT query_id, rank, rank || '. ' || doc_id || ' — ' || lang AS heading, relevance || ' (' || format('{{:.2f}}', score) || ')' AS relevance
FROM (SELECT query_id, rank, doc_id, lang, score, {_RELEVANCE} FROM ranks JOIN documents USING (doc_id) WHERE rank <= 5)""")
oracle("search_response", "search", """
SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS policy_number, lang AS policy_type, text AS search_text, round(score, 6) AS score
FROM ranks JOIN documents USING (doc_id) WHERE rank <= 5""")
oracle("clean_completion", "", r"""
SELECT conv_id, turn, replace(replace(replace(replace(text, chr(10), '\n'), '\n', chr(10)), '\t', ' ') || ' cost $5', '$', '\$') AS answer
FROM conversations""")
oracle("search_quality_gate", "search",
       f"""
SELECT q.query_id, round(coalesce(max(score), 0), 6) AS best_score, coalesce(max(score), 0) >= 0.5 AS passed
FROM (SELECT unnest(range({len(vocab.SAMPLE_QUESTIONS) + 1})) AS query_id) q LEFT JOIN ranks USING (query_id) GROUP BY 1""")

# --- streaming and repair --------------------------------------------------------------------------

_STATUS_COUNTS = f"SELECT status, count(*) AS cnt FROM ({_APPLIED}) GROUP BY 1"
oracle("stream_status_counts", "claims parsed", _STATUS_COUNTS)
oracle("compacted_status_counts", "claims parsed", _STATUS_COUNTS)
oracle("ingest_notes_stream", "notes", "SELECT * EXCLUDE (file_name) FROM extracted")
oracle("malformed_decisions", "responses", """SELECT '{"claim_id": "' || claim_id || '"' AS record FROM responses""")
oracle("hash_bucket", "claims", f"SELECT claim_id, {bucket('claim_id', 7)} AS bucket FROM claims")
oracle("repair_claim_types", "retyped", "SELECT claim_id, policy_type, claim_type FROM retyped")
oracle("repair_descriptions", "retyped", f"""
SELECT claim_id, CASE WHEN {_COVERED} THEN {simple_case("policy_type", vocab.DESCRIPTION_PLACES)} || ': '
       || ({_EVENTS})[{bucket('claim_id', f'len({_EVENTS})')} + 1] ELSE description END AS description
FROM retyped""")
oracle("repair_names", "claims", f"SELECT claim_id, country, coalesce(surname, last_name) AS last_name FROM ({_BY_NAME})")
oracle("reset_evaluations", "judged", f"""
SELECT claim_id,
       CASE WHEN status = 'Pending' AND next_status IN ('Approved', 'Denied') THEN {_pick(vocab.OPEN_STATUSES, "claim_id || 'status'")}
            WHEN status = 'Pending' THEN next_status ELSE status END AS status,
       CAST(NULL AS VARCHAR) AS ai_decision, CAST(NULL AS VARCHAR) AS ai_reasoning
FROM outcome""")
oracle("status_gate", "judged", """
SELECT next_status AS status, count(*) AS violations FROM outcome WHERE status = 'Pending' AND next_status IN ('Approved', 'Denied') GROUP BY 1""")
oracle("market_coverage_gate", "claims", f"""
SELECT m.country, count(c.claim_id) AS cnt, count(c.claim_id) BETWEEN 20 AND 30 AS passed
FROM (SELECT unnest({texts(vocab.MARKETS.values())}) AS country) m LEFT JOIN claims c USING (country) GROUP BY 1""")
oracle("name_country_gate", "claims", f"""
SELECT claim_id, country, last_name FROM claims WHERE country IN ({words(vocab.MARKETS.values())}) AND NOT list_contains({_POOL}, last_name)""")
_CLOSED = ", ".join(f"({q(x)})" for x in vocab.CLOSED_STATUSES)
_LOW, _HIGH = vocab.CLAIMS_PER_MARKET
oracle("build_gates", "claims", f"""
SELECT gate, item, found, CASE gate WHEN 'rows' THEN true WHEN 'market' THEN found BETWEEN {_LOW} AND {_HIGH} ELSE found = 0 END AS passed
FROM (
  SELECT 'rows' AS gate, 'claims' AS item, count(*) AS found FROM claims
  UNION ALL SELECT 'names', 'outside the pool', count(*) FROM ({ORACLES['name_country_gate']})
  UNION ALL SELECT 'violations', check_name, violations FROM ({ORACLES['violation_counts']})
  UNION ALL SELECT 'early status', s.status, count(c.status) FROM (VALUES {_CLOSED}) s(status)
    LEFT JOIN claims c ON c.status = s.status AND trim(coalesce(c.ai_decision, '')) = '' GROUP BY s.status
  UNION ALL SELECT 'market', country, cnt FROM ({ORACLES['market_coverage_gate']}))""")
