"""Evaluation of claims as set-based column work, and the write-back of decisions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.functions import responses, scalars as fn
from claimflow.operators import quality

# Our own definition: the country exposure at which the risk score stops rising.
EXPOSURE_CAP = 0.05
MONEY = "decimal(18,2)"


def parse_decisions(responses_df: DataFrame, on_error: str = "REFER", text: str = "response") -> DataFrame:
    """Parse a column of evaluation responses; a response is never an error.

    With on_error "REFER" an unreadable response becomes REFER with score 5 and payout 0, and
    an object without a decision counts as REFER. With "ERROR" they become ERROR and UNKNOWN.
    `accepted` is the text of the object that was read, with all its keys, NULL without one.
    """
    if on_error not in ("REFER", "ERROR"):
        raise ValueError("on_error is REFER or ERROR")
    refer = on_error == "REFER"
    parsed, clean, whole = F.col("_parsed"), F.col("_clean"), F.col("_whole")
    retry = responses.only(whole).isNull() & ~responses.is_json_array(clean)
    # A column of its own, as it is read several times: what is written out twice is made twice.
    span = F.col("_span")
    failed = parsed.isNull()
    fallback_score = F.lit("5") if refer else F.lit(None).cast("string")
    fallback_payout = F.lit(0).cast(MONEY) if refer else F.lit(None).cast(MONEY)
    unstated = F.lit("REFER" if refer else "UNKNOWN")
    return (
        responses_df.withColumn("_clean", responses.without_fence(F.col(text)))
        .withColumn("_whole", responses.as_objects(clean))
        .withColumn("_span", F.when(retry, responses.widest_braces(clean)))
        .withColumn("_inner", responses.as_objects(span))
        .withColumn("_parsed", F.coalesce(responses.only(whole), responses.only(F.col("_inner"))))
        .withColumns(
            {
                "decision": F.when(failed, F.lit(on_error)).otherwise(F.coalesce(parsed["decision"], unstated)),
                "risk_score": F.when(failed, fallback_score).otherwise(parsed["risk_score"]),
                "recommended_payout": F.when(failed, fallback_payout).otherwise(
                    parsed["recommended_payout"].try_cast(MONEY)
                ),
                "reasoning": F.when(failed, clean).otherwise(parsed["reasoning"]),
                "accepted": F.when(responses.only(whole).isNotNull(), clean).when(
                    ~failed, span
                ),
            }
        )
        .drop("_clean", "_whole", "_span", "_inner", "_parsed")
    )


def previous_evaluation(claims: DataFrame) -> DataFrame:
    """Stored evaluations read back; stored columns fill what the stored JSON lacks."""
    decided = claims.filter(~fn.is_blank(F.col("ai_decision")))
    objects = responses.as_objects(F.col("ai_reasoning"))
    has_text = F.coalesce(F.col("ai_reasoning") != "", F.lit(False))
    own_text = F.when(has_text, F.col("ai_reasoning"))
    read = decided.withColumn("_objects", objects).withColumn("_stored", responses.only(F.col("_objects")))
    return read.select(
        "claim_id",
        F.coalesce(F.col("_stored")["decision"], "ai_decision").alias("decision"),
        F.coalesce(F.col("_stored")["risk_score"], F.lit("N/A")).alias("risk_score"),
        F.coalesce(F.col("_stored")["recommended_payout"], F.lit("0")).alias("recommended_payout"),
        F.coalesce(F.col("_stored")["reasoning"], own_text, F.lit("No reasoning provided")).alias("reasoning"),
    )


# --- rule-based evaluation -----------------------------------------------------------------------


def _inputs_known() -> Column:
    needed = ["claim_amount", "coverage_limit", "deductible", "claim_type", "policy_type"]
    known = F.lit(True)
    for name in needed:
        known = known & F.col(name).isNotNull()
    return known


def rule_decision() -> Column:
    """Above the limit: DENY; type not covered: DENY; inputs missing: REFER; else APPROVE."""
    return (
        F.when(F.col("claim_amount") > F.col("coverage_limit"), "DENY")
        .when(~quality.is_covered(), "DENY")
        .when(~_inputs_known(), "REFER")
        .otherwise("APPROVE")
    )


def rule_reasoning() -> Column:
    return (
        F.when(F.col("claim_amount") > F.col("coverage_limit"), "Claim amount exceeds the coverage limit.")
        .when(~quality.is_covered(), "Claim type is not covered by the policy type.")
        .when(~_inputs_known(), "Claim needs investigation: inputs are missing.")
        .otherwise("Claim is covered and within the limit.")
    )


def payout(decision: Column) -> Column:
    """Our own formula: an approved claim pays the amount within the limit, less the deductible."""
    within = F.least("claim_amount", "coverage_limit") - F.col("deductible")
    paid = F.greatest(within, F.lit(0).cast(MONEY)).cast(MONEY)
    return F.when(decision == "APPROVE", paid).otherwise(F.lit(0).cast(MONEY))


def risk_score(exposure_cap: float = EXPOSURE_CAP) -> Column:
    """Our own formula, 1 to 10: up to 6 points for the used limit, up to 3 for the country."""
    limit = F.nullif(F.col("coverage_limit").cast("double"), F.lit(0.0))
    used = F.least(F.coalesce(F.col("claim_amount").cast("double") / limit, F.lit(1.0)), F.lit(1.0))
    exposure = F.least(F.coalesce("country_disaster_exposure", F.lit(0.0)) / exposure_cap, F.lit(1.0))
    points = F.round(1 + 6 * used + 3 * exposure, 0).cast("int")
    return F.least(F.greatest(points, F.lit(1)), F.lit(10))


def evaluate(claims: DataFrame) -> DataFrame:
    """Claims with decision, risk score, payout and reasoning; no shuffle."""
    return (
        claims.withColumn("decision", rule_decision())
        .withColumn("risk_score", risk_score())
        .withColumn("recommended_payout", payout(F.col("decision")))
        .withColumn("reasoning", rule_reasoning())
    )


def decision_json() -> Column:
    return F.to_json(F.struct("decision", "risk_score", "recommended_payout", "reasoning"))


# --- write-back ----------------------------------------------------------------------------------


def newest_numbered(decisions: DataFrame) -> DataFrame:
    """One decision per claim, the newest; a decision without a time is the oldest.

    The newest is told by a number, its time and then a hash of what was said, so that a hash
    aggregate keeps one such number per claim and nothing is sorted; the decision with the number is
    joined back. Equal times are settled the same way on every run. What was said is hashed as it
    came where it is still there, so the first pass need not parse it.
    """
    if "accepted" not in decisions.columns:
        decisions = decisions.withColumn("accepted", F.lit(None).cast("string"))
    columns = ["claim_id", "number", "decided_at", "decision", "risk_score", "recommended_payout", "reasoning", "accepted"]
    said = ["response"] if "response" in decisions.columns else columns[3:]
    numbered = decisions.filter(F.col("claim_id").isNotNull()).withColumn("number", _number(F.col("decided_at"), F.xxhash64(*said)))
    newest = numbered.groupBy("claim_id").agg(F.max("number").alias("number"))
    # No number is above the newest; asked this way the rows meet by claim, as they are dealt for the write-back.
    newest = newest.withColumnRenamed("number", "most")
    return numbered.join(newest, "claim_id").filter(F.col("number") >= F.col("most")).select(*columns).distinct()


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return newest_numbered(decisions).drop("number")


def _number(time: Column, said: Column) -> Column:
    """A decimal, as it is changed in place by an aggregate: first the time, then the hash."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, time.cast("timestamp_ntz")).cast("decimal(19,0)")
    oldest = F.lit(-(1 << 62)).cast("decimal(19,0)")
    shifted = F.coalesce(micros, oldest) * F.lit(1 << 62).cast("decimal(19,0)")
    return (shifted.cast("decimal(38,0)") + F.shiftrightunsigned(said, 2).cast("decimal(19,0)")).cast("decimal(38,0)")


def decisions_onto_claims(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims beside their newest decision, if any. A claim is never lost or doubled.

    What is stored is the JSON as it was accepted; a decision that came without one is written
    as JSON of its four fields.
    """
    found = latest_decisions(decisions).select(
        "claim_id",
        F.col("decision").alias("new_decision"),
        F.coalesce("accepted", decision_json()).alias("new_reasoning"),
    )
    return claims.join(found, "claim_id", "left")


def apply_decisions(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next version of the claims table: three columns change where a decision exists."""
    hit = F.col("new_decision").isNotNull()
    return (
        decisions_onto_claims(claims, decisions)
        .withColumns(
            {
                "ai_decision": F.coalesce("new_decision", "ai_decision"),
                "ai_reasoning": F.when(hit, F.col("new_reasoning")).otherwise(F.col("ai_reasoning")),
                "status": F.when(hit, fn.decision_to_status(F.col("new_decision"))).otherwise(F.col("status")),
            }
        )
        .select(*claims.columns)
    )


def evaluate_where(claims: DataFrame, condition: Column) -> DataFrame:
    """The next version of the claims table with the claims that meet a condition evaluated.

    The decision follows from the claim's own row, so the write-back needs no join: one narrow
    pass over the table. A claim evaluated before is evaluated again.
    """
    chosen = F.coalesce(condition, F.lit(False))
    return (
        evaluate(claims)
        .withColumns(
            {
                "ai_decision": F.when(chosen, F.col("decision")).otherwise(F.col("ai_decision")),
                "ai_reasoning": F.when(chosen, decision_json()).otherwise(F.col("ai_reasoning")),
                "status": F.when(chosen, fn.decision_to_status(F.col("decision"))).otherwise(F.col("status")),
            }
        )
        .select(*claims.columns)
    )


def batch_evaluate_pending(claims: DataFrame) -> DataFrame:
    """Every pending claim evaluated, in one job."""
    return evaluate_where(claims, F.col("status") == "Pending")


def evaluate_claim(claims: DataFrame, claim_id: str) -> DataFrame:
    """The evaluation of one claim, whatever its status, as fields and as JSON."""
    one = evaluate(claims.filter(F.col("claim_id") == F.lit(claim_id)))
    return one.select(
        "claim_id", "decision", "risk_score", "recommended_payout", "reasoning", decision_json().alias("result")
    )


def status_transitions(claims: DataFrame) -> DataFrame:
    """Status and decision of each pending claim before and after its evaluation."""
    pending = evaluate(claims.filter(F.col("status") == "Pending"))
    return pending.select(
        "claim_id",
        F.col("status").alias("old_status"),
        fn.decision_to_status(F.col("decision")).alias("new_status"),
        F.coalesce("ai_decision", F.lit("None")).alias("old_decision"),
        F.col("decision").alias("new_decision"),
        "risk_score",
        fn.risk_band(F.col("risk_score")).alias("risk_band"),
    )


def evaluation_display(evaluated: DataFrame) -> DataFrame:
    """Evaluations as report text: status banner, risk label, payout and reasoning.

    Needs claim_id, the status before, and the four decision columns. What a response left out
    reads as it would on screen: no risk label, a payout of zero, a stock sentence.
    """
    score, after = F.col("risk_score"), fn.decision_to_status(F.col("decision"))
    reasoning = F.coalesce("reasoning", F.lit("No reasoning provided"))
    return evaluated.select(
        "claim_id",
        F.coalesce("decision", F.lit("UNKNOWN")).alias("decision"),
        F.concat(F.lit("Claim status updated: "), F.col("status"), F.lit(" → "), after).alias("banner"),
        F.concat(
            fn.risk_points(score).cast("string"), F.lit("/10 — "), fn.risk_band(score), F.lit(" Risk")
        ).alias("risk_label"),
        fn.dollars(F.coalesce("recommended_payout", F.lit(0).cast(MONEY))).alias("payout"),
        F.replace(reasoning, F.lit("$"), F.lit("\\$")).alias("reasoning"),
    )


def version_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims whose status or decision differs between two stored versions of the table."""
    before = old.select("claim_id", F.col("status").alias("old_status"), F.col("ai_decision").alias("old_decision"))
    after = new.select("claim_id", F.col("status").alias("new_status"), F.col("ai_decision").alias("new_decision"))
    same = F.col("old_status").eqNullSafe(F.col("new_status")) & F.col("old_decision").eqNullSafe(
        F.col("new_decision")
    )
    return before.join(after, "claim_id").filter(~same)
