"""Scalar expressions: text, buckets, bands, rates and report formats."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimflow import vocab


# The white space characters, Unicode included.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(text: Column) -> Column:
    """Drop all white space at both ends (`trim` alone drops blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for NULL and for text that is empty once stripped."""
    return text.isNull() | (strip_ws(text) == "")


def hash_bucket(key: Column, buckets: int | Column) -> Column:
    """A stable bucket 0..buckets-1 of a key, the same on every run and every cluster."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def pick(options: list[str], key: Column) -> Column:
    """One of a fixed list of options, by the bucket of the key."""
    return F.element_at(F.array(*map(F.lit, options)), (hash_bucket(key, len(options)) + 1).cast("int"))


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table; NULL for a key it does not hold."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def list_lookup(table: dict[str, list[str]], key: Column) -> Column:
    """List held by a small fixed table of lists; NULL for a key it does not hold."""
    pairs = [c for k, v in table.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- geography -------------------------------------------------------------------------------


def geo_code(geo_id: Column) -> Column:
    return F.split_part(geo_id, F.lit("/"), F.lit(2))


def geo_to_country(geo_id: Column, markets: dict[str, str] = vocab.MARKETS) -> Column:
    """Country name of a geo id; NULL when its code is not one of the markets."""
    return lookup(markets, geo_code(geo_id))


# --- bands and mappings ------------------------------------------------------------------------


def decision_to_status(decision: Column) -> Column:
    return F.coalesce(lookup(vocab.STATUS_AFTER, decision), F.lit(vocab.STATUS_OTHERWISE))


def _finite(score: Column) -> Column:
    """A score given as number or text; NULL when it is no finite number."""
    text = score.cast("string")
    # A trailing d or f is Java's mark for a number's type, not part of a score.
    number = F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def risk_points(score: Column) -> Column:
    """The score cut to a whole number."""
    return _finite(score).try_cast("bigint")


def risk_band(score: Column) -> Column:
    """Low up to 3, Medium up to 6, High above, after the cut; the score's range is not checked."""
    number = _finite(score)
    return F.when(number < 4, "Low").when(number < 7, "Medium").when(number.isNotNull(), "High")


def risk_percent(score: Column) -> Column:
    return risk_points(score) * 10


def relevance_band(
    score: Column, high: float = vocab.HIGH_RELEVANCE, medium: float = vocab.MEDIUM_RELEVANCE
) -> Column:
    """Both thresholds are strict; a missing score counts as Low."""
    return F.when(score > high, "High").when(score > medium, "Medium").otherwise("Low")


# --- rates -----------------------------------------------------------------------------------


def to_percent(ratio: Column, digits: int | None = None) -> Column:
    scaled = ratio * 100
    return scaled if digits is None else F.round(scaled, digits)


def to_ratio(percent: Column) -> Column:
    return percent / 100


def to_millions(count: Column, digits: int = 1) -> Column:
    return F.round(count / 1_000_000, digits)


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL instead of an error when whole is zero."""
    return part / F.nullif(whole, F.lit(0))


# --- report formats ----------------------------------------------------------------------------


def whole_number(value: Column) -> Column:
    return F.format_number(value, 0)


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 0))


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(value, digits), F.lit("%"))


def or_not_available(value: Column, text: Column) -> Column:
    """The text, or N/A when the value behind it is missing or zero."""
    return F.when(value.isNotNull() & (value != 0), text).otherwise("N/A")
