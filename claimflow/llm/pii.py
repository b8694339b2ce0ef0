"""Format-preserving pseudonyms for personal data, in DataFrame functions alone (operator 3)."""

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.llm.text import table, unused

ROUNDS = 6
# Dates from the first day of 1800 over one Gregorian cycle of 400 years: 189 * 773 days.
DAY_ZERO, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773

# What is looked for. Runs are possessive and start at a word's edge, so a scan is linear.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
# A labelled secret: what stands in quotes, what is set with =, and after a colon what holds a digit.
_LABEL = r"(?i:password|passwd|secret|token|api_key)"
_VALUE = r"[^\s\"'<>,;&]{8,}+"
_SECRET = (
    rf"(?<={_LABEL}[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)"
    rf"(?:(?<=[\"'])[^\s\"']{{6,}}+(?=[\"'])|(?<==[ ]{{0,2}}){_VALUE}|(?=[^\s\"'<>,;&0-9]*+[0-9]){_VALUE})"
)
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)+",
    "key": r"(?<![0-9A-Za-z])AKIA[A-Z0-9]{16}(?![0-9A-Za-z])",
    "secret": _SECRET,
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*+(?![0-9A-Za-z:]))(?=[A-Fa-f:]*+[0-9])(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?)",
    "date": r"(?<![0-9A-Za-z./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./-])\d{2}\1\d{4})(?![0-9A-Za-z]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ ]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=\+\d{1,3}[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){2,3})(?![0-9A-Za-z])",
    "line": r"(?<=(?i:phone|tel|mobile|cell|fax)[.]?[ ]{0,2}[:=]?[ ]{0,2})\d{9,12}(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-[0-9])",
}
PATTERN = "|".join(KINDS.values())


def _digest(key: str, kind: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), kind, *(p.cast("string") for p in parts)), 256)


def _number(digest: Column, at: int | Column, digits: int) -> Column:
    """Some hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, digits) if isinstance(at, int) else digest.substr(at, F.lit(digits)), 16, 10).cast("bigint")


def _shifted(half: Column, other: Column, rnd: Column, key: str, kind: Column, letters: Column) -> Column:
    """Each digit and ASCII letter of `half` moved within its class by a keyed hash of the other half."""

    def moved(c: Column, i: Column) -> Column:
        digest = _digest(key, kind, rnd, F.length(half), (i / 32).cast("int"), other)
        by = _number(digest, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), 2)
        code = F.ascii(c)
        within = lambda first, size: F.char(F.pmod(code - first + by, size) + first)
        return (
            F.when(c.rlike("^[0-9]$"), within(F.lit(48), F.lit(10)))
            .when(c.rlike("^[a-z]$"), within(F.lit(97), letters))
            .when(c.rlike("^[A-Z]$"), within(F.lit(65), letters))
            .otherwise(c)
        )

    characters = F.filter(F.split(half, ""), lambda c: c != "")
    return F.array_join(F.transform(characters, moved), "")


def feistel(value: Column, key: str, kind: Column | str, letters: Column | int = 26) -> Column:
    """A keyed permutation of the strings with the form of `value`.

    Digits stay digits, small and capital letters stay such (the first `letters` of the alphabet
    among themselves), everything else stays. Two halves take turns: one is shifted by a hash of
    the other, which every round can undo, so different values never meet.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    letters = F.lit(letters) if isinstance(letters, int) else letters
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(value.substr(F.lit(1), cut).alias("l"), value.substr(cut + 1, F.length(value)).alias("r"))
    rounds = F.array(*map(F.lit, range(ROUNDS)))
    turned = lambda s, n: F.struct(s["r"].alias("l"), _shifted(s["l"], s["r"], n, key, kind, letters).alias("r"))
    return F.aggregate(rounds, start, turned, lambda s: F.concat(s["l"], s["r"]))


def _two_numbers(high: Column, low: Column, key: str, kind: str, m_high: int, m_low: int, joined) -> Column:
    """The same for a pair of numbers below two bounds."""
    start = F.struct(high.cast("bigint").alias("a"), low.cast("bigint").alias("b"))
    drawn = lambda s, n, name: _number(_digest(key, F.lit(kind), n, s[name]), 1, 8)
    turned_a = lambda s, n: F.struct(F.pmod(s["a"] + drawn(s, n, "b"), F.lit(m_high)).alias("a"), s["b"].alias("b"))
    turned_b = lambda s, n: F.struct(s["a"].alias("a"), F.pmod(s["b"] + drawn(s, n, "a"), F.lit(m_low)).alias("b"))
    step = lambda s, n: F.when(n % 2 == 0, turned_a(s, n)).otherwise(turned_b(s, n))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, joined)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced in order."""
    between = F.split(value, "[0-9]", -1)
    each = F.concat(F.filter(F.split(digits, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, each, lambda a, b: F.concat(a, b)), "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(value: Column, key: str) -> Column:
    """A number that passes the Luhn check, as another one with the same first digit and length."""
    digits = _digits(value)
    body = F.concat(F.substring(digits, 1, 1), feistel(digits.substr(F.lit(2), F.length(digits) - 2), key, "card"))
    ends = F.array(*map(F.lit, "0123456789"))
    checked = F.transform(F.array(body), lambda b: F.concat(b, F.filter(ends, lambda d: _luhn(F.concat(b, d)))[0]))[0]
    return F.when(_luhn(digits), _refilled(value, checked)).otherwise(value)


def _mod97(text: Column) -> Column:
    """The number that letters (A is 10) and digits spell, modulo 97."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    """A valid IBAN as another valid one of the same country and form."""
    plain = F.regexp_replace(value, " ", "")
    country, body = F.substring(plain, 1, 2), plain.substr(F.lit(5), F.length(plain))
    valid = _mod97(F.concat(body, F.substring(plain, 1, 4))) == 1

    def made(new: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, new)

    joined = F.transform(F.array(feistel(body, key, "iban")), made)[0]
    gaps = F.split(value, "[A-Z0-9]", -1)
    each = F.concat(F.filter(F.split(joined, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.when(valid, F.array_join(F.zip_with(gaps, each, lambda a, b: F.concat(a, b)), "")).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    octet = lambda i: F.split(value, r"\.")[i].cast("bigint")
    half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    join = lambda s: F.concat(half(s["a"]), F.lit("."), half(s["b"]))
    return _two_numbers(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), key, "ip", 65536, 65536, join)


def _date(value: Column, key: str) -> Column:
    """A date of the 400 years as another one, written alike; day first unless only month first is valid."""
    mark = F.regexp_extract(value, r"^\d{2}([./-])", 1)
    parts = F.split(value, "[./-]")
    read = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    iso, day_first = read(parts[0], parts[1], parts[2]), read(parts[2], parts[1], parts[0])
    month_first = read(parts[2], parts[0], parts[1])
    found = F.when(mark == "", iso).otherwise(F.coalesce(day_first, month_first))
    days = F.datediff(found, F.lit(DAY_ZERO).cast("date"))
    moved = _two_numbers(
        F.floor(days / DAYS_LOW), days % DAYS_LOW, key, "date", DAYS_HIGH, DAYS_LOW,
        lambda s: F.date_add(F.lit(DAY_ZERO).cast("date"), (s["a"] * DAYS_LOW + s["b"]).cast("int")),
    )

    def written(d: Column) -> Column:
        year, month, day = (F.date_format(d, f) for f in ("yyyy", "MM", "dd"))
        return F.when(mark == "", F.concat_ws("-", year, month, day)).otherwise(
            F.when(day_first.isNotNull(), F.concat(day, mark, month, mark, year)).otherwise(F.concat(month, mark, day, mark, year))
        )

    inside = days.between(0, DAYS_HIGH * DAYS_LOW - 1)
    return F.when(F.coalesce(inside, F.lit(False)), F.transform(F.array(moved), written)[0]).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = value.substr(F.length(country) + 1, F.length(value))
    return F.concat(country, _refilled(rest, feistel(_digits(rest), key, "phone")))


def _email(value: Column, key: str) -> Column:
    """All but the last label of the domain."""
    last = F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0)
    return F.concat(feistel(value.substr(F.lit(1), F.length(value) - F.length(last)), key, "email"), last)


def _secret(value: Column, key: str) -> Column:
    return feistel(value, key, "secret", F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), F.lit(6)).otherwise(F.lit(26)))


def pseudonym(value: Column, key: str) -> Column:
    """The stand-in of one found value; a number or date that fails its check stays."""
    whole = lambda kind: value.rlike("^(?:" + KINDS[kind] + ")$")
    return (
        F.when(F.contains(value, F.lit("@")), _email(value, key))
        .when(whole("key"), F.concat(F.lit("AKIA"), feistel(F.substring(value, 5, 16), key, "key")))
        .when(whole("ip"), _ip(value, key))
        .when(whole("ip6"), feistel(value, key, "ip6", 6))
        .when(whole("date"), _date(value, key))
        .when(whole("iban"), _iban(value, key))
        .when(whole("number") & _luhn(_digits(value)), _card(value, key))
        .when(value.rlike(r"^\d{9,12}$"), feistel(value, key, "phone"))
        .when(value.rlike(r"^[+(]") | value.rlike(r"^\d{3}[ .-]\d{3}[ .-]\d{4}$"), _phone(value, key))
        .when(whole("ssn"), _refilled(value, feistel(_digits(value), key, "ssn")))
        .when(whole("number"), value)
        .otherwise(_secret(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, found: str = "found") -> DataFrame:
    """`docs` with the personal data in `text` replaced, and in column `found` how many values were.

    E-mail addresses, phone numbers (plain digits where a label names them), IP addresses, access keys
    and labelled secrets of any length, social security numbers, and those card numbers, IBANs and
    dates that pass their check, become another value of the same format under a permutation
    keyed by `key`: equal values get equal pseudonyms in every document, different ones different
    pseudonyms. Who has the key can undo them. Dates outside 1800 to 2199 stay, as do letters
    beyond ASCII within an address. All else stays as it is, character by character.

    A null text stays null with 0 found, an empty one empty; a very long one is one row's work like any
    other. Only `text` changes; extra columns stay, but for one called as `found`, which is replaced.
    Repeated rows change alike; an empty table gives no rows.
    """
    text, values, stand_ins = F.col("text"), unused(docs, "values"), unused(docs, "stand_ins")
    held = F.coalesce(text.rlike("[0-9@]") | text.rlike(_LABEL), F.lit(False))
    listed = F.when(held, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    each = docs.withColumn(values, listed).withColumn(stand_ins, F.transform(values, lambda v: pseudonym(v, key)))
    filled = F.concat(F.col(stand_ins), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), filled, lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with(values, stand_ins, lambda a, b: a != b), lambda x: x))
    return each.withColumns({"text": F.when(F.size(values) > 0, joined).otherwise(text), found: changed}).drop(values, stand_ins)


def session_key(spark) -> str:
    """The key that the session names in spark.claimflow.pii.key; without one, one is drawn for the session."""
    held = spark.conf.get("spark.claimflow.pii.key", None)
    if held is None:
        held = secrets.token_hex(32)
        spark.conf.set("spark.claimflow.pii.key", held)
    return held


def op3_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
