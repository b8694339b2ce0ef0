"""Structured fields out of free-text inspection notes, with built-in regular expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow import schemas

# Line labels and section headings that occur in the notes.
_CLAIM = r"(?m)^Claim Number:\s*(\S+)"
_ADJUSTER = r"(?m)^(?:Field )?Adjuster:\s*([^(\n]+?)\s*\("
_DATE = r"(?m)^Date of (?:Inspection|Report):\s*(.+?)\s*$"
_TOTAL_LINE = r"(?im)^Total[^:\n]*:\s*(.+)$"
_USD = r"USD ([\d,]+(?:\.\d+)?)"
_DOLLAR = r"\$([\d,]+(?:\.\d+)?)"
_ITEM = r"(?m)^(?:- |\d+\. )?[A-Za-z0-9][^:\n]*: (?:USD |HKD |SGD |\$)([\d,]+(?:\.\d+)?)[ ]*$"
_DAMAGE_HEADINGS = ["DAMAGE ASSESSMENT", "OBSERVED DAMAGES"]
_ADVICE_HEADINGS = ["RECOMMENDATION", "RECOMMENDATIONS", "FINDINGS"]
_COST_HEADINGS = ["COST BREAKDOWN", "TREATMENT PLAN COSTS"]


def _lines(notes: DataFrame) -> DataFrame:
    """Notes with Windows line ends made plain, so that headings and empty lines are found."""
    return notes.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def section(text: Column, heading: str) -> Column:
    """Text below a heading up to the next empty line; NULL when the heading is absent."""
    lines = F.concat(F.lit("\n"), text)
    below = F.split_part(lines, F.lit(f"\n{heading}:\n"), F.lit(2))
    return F.nullif(F.rtrim(F.split_part(below, F.lit("\n\n"), F.lit(1)), F.lit("\n")), F.lit(""))


def _first_section(text: Column, headings: list[str]) -> Column:
    return F.coalesce(*[section(text, h) for h in headings])


def _date(written: Column) -> Column:
    """A date in either of two spellings. The spelling is told apart first: a failed parse is slow."""
    iso = F.when(written.rlike("^[0-9]{4}-"), F.try_to_date(written, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(written.rlike("^[A-Z]"), F.try_to_date(written, "MMMM d, yyyy")))


def _amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def extract_notes(notes: DataFrame, keep_text: bool = False) -> DataFrame:
    """(file_name, text) to the seven note columns, and the text where it is asked for.

    The amount is the stated gross total in USD: on the total line the figure marked USD, else
    the first one marked $. What a note does not say stays NULL.
    """
    text, written, total = F.col("text"), F.col("_written"), F.col("_total")
    lines = _lines(notes).withColumns({"_written": _first(text, _DATE), "_total": _first(text, _TOTAL_LINE)})
    return lines.select(
        "file_name",
        _first(text, _CLAIM).alias("claim_id"),
        _first(text, _ADJUSTER).alias("adjuster_name"),
        _date(written).cast("string").alias("inspection_date"),
        _first_section(text, _DAMAGE_HEADINGS).alias("damage_assessment"),
        _amount(F.coalesce(_first(total, _USD), _first(total, _DOLLAR))).alias("estimated_amount"),
        _first_section(text, _ADVICE_HEADINGS).alias("recommendation"),
        *(["text"] if keep_text else []),
    )


def itemized_totals(notes: DataFrame) -> DataFrame:
    """Sum of a note's top-level cost items, in the note's own currency, beside the stated total.

    Indented sub-items and the total line are left out; a difference is reported, not repaired.
    A note without items has no sum.
    """
    text, money = F.col("text"), "decimal(18,2)"
    costs = F.coalesce(*[_first(text, rf"(?s)(?:^|\n){h}:\n(.*?)(?:(?<=\n)Total|$)") for h in _COST_HEADINGS])
    figures = F.regexp_extract_all(costs, F.lit(_ITEM), F.lit(1))
    stated = _first(_first(text, _TOTAL_LINE), r"([\d,]+(?:\.\d+)?)")
    total = F.aggregate(
        F.transform(figures, lambda x: F.coalesce(_amount(x), F.lit(0).cast(money))),
        F.lit(0).cast(money),
        lambda acc, x: (acc + x).cast(money),
    )
    return _lines(notes).select(
        "file_name",
        _amount(stated).alias("stated_total"),
        F.when(F.size(figures) > 0, total).alias("itemized_total"),
    )


def dataset_notes(extracted: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The extracted columns at their declared types, and `extra` ones as they are."""
    return extracted.select(*schemas.names(schemas.NOTES), *(extra or [])).withColumn(
        "estimated_amount", F.col("estimated_amount").cast("decimal(18,2)")
    )
