"""Rule checks and gates over the claims table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn
from claimflow.session import fixed_rows


def is_covered() -> Column:
    """Whether the policy type covers the claim type, in three-valued logic."""
    return fn.any_of(
        [
            (F.col("policy_type") == policy) & F.col("claim_type").isin(types)
            for policy, types in vocab.COVERED_CLAIM_TYPES.items()
        ]
    )


def claim_type_mismatch(claims: DataFrame) -> DataFrame:
    """Claims that break the coverage table for certain; an unknown outcome is not reported."""
    return claims.filter(~is_covered()).select("claim_id", "claim_type", "policy_type")


def coverage_pairs(spark: SparkSession) -> DataFrame:
    """The covered (policy type, claim type) pairs, closed under "one side is unknown"."""
    pairs = {(p, t) for p, types in vocab.COVERED_CLAIM_TYPES.items() for t in types}
    open_ended = {(p, None) for p, _ in pairs} | {(None, t) for _, t in pairs} | {(None, None)}
    rows = sorted(pairs | open_ended, key=str)
    return fixed_rows(spark, "covered_policy string, covered_type string", rows)


def mismatch_anti_join(claims: DataFrame) -> DataFrame:
    """The same rows as `claim_type_mismatch`, as a null-safe broadcast hash anti join."""
    pairs = F.broadcast(coverage_pairs(claims.sparkSession))
    same = F.col("policy_type").eqNullSafe(F.col("covered_policy")) & F.col("claim_type").eqNullSafe(
        F.col("covered_type")
    )
    return claims.join(pairs, same, "left_anti").select("claim_id", "claim_type", "policy_type")


def _breaks(rule: tuple) -> Column:
    _, claim_type, policy_type, words = rule
    held = fn.any_of([F.col("description").ilike(f"%{word}%") for word in words])
    here = F.col("policy_type") == policy_type
    return here & held if claim_type is None else here & (F.col("claim_type") == claim_type) & held


def description_violations(claims: DataFrame, rules: list[tuple] = vocab.DESCRIPTION_RULES) -> DataFrame:
    return claims.filter(fn.any_of([_breaks(r) for r in rules])).select(
        "claim_id", "claim_type", "policy_type", "description"
    )


def description_violations_by_rule(
    claims: DataFrame, rules: list[tuple] = vocab.DESCRIPTION_RULES_FULL
) -> DataFrame:
    """One row per claim and broken rule."""
    broken = F.array_compact(F.array(*[F.when(_breaks(r), F.lit(r[0])) for r in rules]))
    return claims.select("claim_id", "claim_type", "policy_type", F.explode(broken).alias("rule"))


def _checks() -> dict[str, Column]:
    """The violations that are counted, by name."""
    checks = {"claim_type": ~is_covered()} | {r[0]: _breaks(r) for r in vocab.DESCRIPTION_RULES}
    checks["description"] = fn.any_of([_breaks(r) for r in vocab.DESCRIPTION_RULES])
    return checks


def violation_counts(claims: DataFrame) -> DataFrame:
    """Violations per check, counted in one pass; a clean table shows zeros."""
    checks = _checks()
    counted = claims.agg(*[F.count_if(breaks).alias(name) for name, breaks in checks.items()])
    return counted.unpivot([], list(checks), "check_name", "violations")


def row_count_gate(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Row count per table beside the expected count."""
    counts = [
        df.agg(F.count("*").alias("cnt")).select(F.lit(name).alias("tbl"), "cnt") for name, df in tables.items()
    ]
    wanted = fn.lookup(expected, F.col("tbl")).cast("bigint")
    return (
        reduce(DataFrame.unionByName, counts)
        .withColumn("expected", wanted)
        .withColumn("passed", F.coalesce(F.col("cnt") == F.col("expected"), F.lit(False)))
    )


def status_gate(claims: DataFrame) -> DataFrame:
    """Claims that carry a closing status before any evaluation, counted per status."""
    early = claims.filter(F.col("status").isin(vocab.CLOSED_STATUSES) & fn.is_blank(F.col("ai_decision")))
    return early.groupBy("status").agg(F.count("*").alias("violations"))


def market_coverage_gate(
    claims: DataFrame,
    bounds: tuple[int, int] = vocab.CLAIMS_PER_MARKET,
    markets: dict[str, str] = vocab.MARKETS,
) -> DataFrame:
    """Claims per market, zero included, and whether the number lies within the bounds."""
    spark = claims.sparkSession
    listed = fixed_rows(spark, "country string", [(name,) for name in markets.values()])
    counts = claims.groupBy("country").agg(F.count("*").alias("cnt"))
    # One row per listed market that occurs: the list bounds what is broadcast.
    few = counts.filter(F.col("country").isin(list(markets.values())))
    return (
        listed.join(F.broadcast(few), "country", "left")
        .select("country", F.coalesce("cnt", F.lit(0)).alias("cnt"))
        .withColumn("passed", F.col("cnt").between(*bounds))
    )


def surname_pool(spark: SparkSession) -> DataFrame:
    rows = [(c, i, s) for c, pool in vocab.SURNAMES.items() for i, s in enumerate(pool)]
    return fixed_rows(spark, "country string, idx bigint, surname string", rows)


def name_country_gate(claims: DataFrame) -> DataFrame:
    """Claims of a market whose surname is not in the market's pool."""
    pool = F.broadcast(surname_pool(claims.sparkSession).withColumnRenamed("surname", "last_name"))
    in_markets = claims.filter(F.col("country").isin(list(vocab.SURNAMES)))
    return in_markets.join(pool, ["country", "last_name"], "left_anti").select("claim_id", "country", "last_name")


def observed(claims: DataFrame) -> tuple[DataFrame, Observation]:
    """Claims that count what the gates ask for while something else reads them, and where the counts come.

    All gates over the claims ride on the write that stores them: no further pass over the table. The
    counts are there once the write is done; `gate_figures` makes rows of them.
    """
    surnames = fn.any_of([(F.col("country") == c) & F.col("last_name").isin(pool) for c, pool in vocab.SURNAMES.items()])
    in_pool = F.coalesce(surnames, F.lit(False))
    early = F.col("status").isin(vocab.CLOSED_STATUSES) & fn.is_blank(F.col("ai_decision"))
    counts = {"rows|claims": F.lit(True), "names|outside the pool": F.col("country").isin(list(vocab.SURNAMES)) & ~in_pool}
    counts |= {f"violations|{name}": breaks for name, breaks in _checks().items()}
    counts |= {f"early status|{status}": early & (F.col("status") == status) for status in vocab.CLOSED_STATUSES}
    counts |= {f"market|{name}": F.col("country") == name for name in vocab.MARKETS.values()}
    seen = Observation("claims gates")
    return claims.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()]), seen


def gate_figures(spark: SparkSession, seen: Observation, expected_rows: int | None = None, per_market: tuple[int, int] = vocab.CLAIMS_PER_MARKET) -> DataFrame:
    """A row per gate and item: what was found, and whether it passes. No row count is asked for without `expected_rows`."""

    def passes(gate: str, found: int) -> bool:
        if gate == "rows":
            return expected_rows in (None, found)
        return per_market[0] <= found <= per_market[1] if gate == "market" else found == 0

    rows = [(*name.split("|"), found, passes(name.split("|")[0], found)) for name, found in seen.get.items()]
    return fixed_rows(spark, "gate string, item string, found bigint, passed boolean", rows)
