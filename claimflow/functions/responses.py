"""Reading of evaluation responses: fenced, wrapped in prose, or not JSON at all."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimflow.functions.scalars import strip_ws

_SCHEMA = "array<struct<decision string, risk_score string, recommended_payout string, reasoning string>>"
_OPTIONS = {"allowSingleQuotes": "false"}
_JSON_SPACE = " \t\n\r"
_END = "end of response"


# How a Markdown code fence opens and closes.
_FENCE_OPENS, _FENCE_CLOSES = r"^```(?:json)?\s*", r"\s*```$"


def without_fence(text: Column) -> Column:
    """Strip white space and, where the text opens with one, the Markdown code fence."""
    bare = strip_ws(text)
    opened = F.regexp_replace(bare, _FENCE_OPENS, "")
    return F.when(bare.startswith("```"), F.regexp_replace(opened, _FENCE_CLOSES, "")).otherwise(bare)


def as_objects(text: Column) -> Column:
    """The JSON objects a text consists of and an end mark, as an array; NULL where it is not JSON.

    `from_json` on its own also takes text that follows the object. Here the text is the first of
    two array elements, so it has to be read to its end before the end mark can be met.
    """
    bare = F.btrim(text, F.lit(_JSON_SPACE))
    marked = F.concat(F.lit("["), bare, F.lit(f', {{"decision": "{_END}"}}]'))
    return F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(marked, _SCHEMA, _OPTIONS))


def only(objects: Column) -> Column:
    """The single object in front of the end mark, else NULL."""
    ended = F.get(objects, F.lit(1))["decision"] == _END
    return F.when((F.size(objects) == 2) & ended, F.get(objects, F.lit(0)))


def widest_braces(text: Column) -> Column:
    """From the first opening to the last closing brace; NULL when there is no such span."""
    start = F.instr(text, "{")
    # What follows the last brace, the whole text where there is none; `end` is then 0.
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((start > 0) & (end > start), F.substring(text, start, end - start + 1))


def is_json_array(text: Column) -> Column:
    """True when the whole text is one JSON array, which no response reader accepts."""
    marked = F.concat(F.lit("["), text, F.lit(f', "{_END}"]'))
    second = F.get(F.from_json(marked, "array<string>", _OPTIONS), F.lit(1))
    return F.when(text.startswith("["), F.coalesce(second == _END, F.lit(False))).otherwise(F.lit(False))


def clean_completion(text: Column) -> Column:
    """Free-text completion made readable: outer quotes off, escapes resolved, $ escaped."""
    bare = strip_ws(text)
    quoted = bare.startswith('"') & bare.endswith('"')
    inner = F.when(quoted, F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0)))).otherwise(bare)
    lines = F.replace(inner, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(lines, F.lit("\\t"), F.lit(" ")), F.lit("$"), F.lit("\\$"))

