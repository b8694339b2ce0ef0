"""Country risk from a long time series: newest value per indicator, then one row per country."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import scalars as fn


def filter_in_markets(timeseries: DataFrame, markets: dict[str, str] = vocab.MARKETS) -> DataFrame:
    return timeseries.filter(F.col("geo_id").isin([vocab.GEO_PREFIX + code for code in markets]))


def scan_timeseries(timeseries: DataFrame, markets: dict[str, str] = vocab.MARKETS) -> DataFrame:
    """Rows of the markets that hold a value; both conditions reach the parquet scan."""
    return filter_in_markets(timeseries, markets).filter(F.col("value").isNotNull())


def latest_value(timeseries: DataFrame) -> DataFrame:
    """The newest row per entity and indicator name.

    A missing date counts as newest; the larger value settles equal dates. Two hash aggregates
    with buffers of fixed width: the newest date per group, then the largest value among the rows
    of that date. Neither sorts a row, and one row per group leaves each task, so an entity that
    holds most of the rows costs no more than any other. The series is read twice for it.
    """
    keys = ["geo_id", "variable_name"]
    newest = timeseries.groupBy(*keys).agg(
        F.bool_or(F.col("date").isNull()).alias("undated"), F.max("date").alias("dated")
    ).select(
        F.col("geo_id").alias("_geo"),
        F.col("variable_name").alias("_name"),
        F.when(~F.col("undated"), F.col("dated")).alias("_date"),
    )
    of_newest = (
        F.col("geo_id").eqNullSafe(F.col("_geo"))
        & F.col("variable_name").eqNullSafe(F.col("_name"))
        & F.col("date").eqNullSafe(F.col("_date"))
    )
    rows = timeseries.select(*keys, "date", "value").join(newest, of_newest, "left_semi")
    return rows.groupBy(*keys, "date").agg(F.max("value").alias("value"))


def _largest(name_matches: Column) -> Column:
    return F.max(F.when(name_matches, F.col("value")))


def risk_pivot(latest: DataFrame) -> DataFrame:
    """One row per entity with four indicators; of several names that match, the larger value."""
    name = F.col("variable_name")
    return latest.groupBy("geo_id").agg(
        _largest(name.ilike(vocab.GDP_PATTERN)).alias("gdp"),
        _largest(name.ilike(vocab.PENETRATION_PATTERN)).alias("penetration_pct"),
        _largest(name.ilike(vocab.DISPLACED_PATTERN)).alias("displaced"),
        _largest(name == vocab.POPULATION_NAME).alias("population"),
    )


def risk_columns(pivot: DataFrame, markets: dict[str, str] = vocab.MARKETS) -> DataFrame:
    geo = F.col("geo_id")
    return pivot.select(
        fn.geo_to_country(geo, markets).alias("country"),
        fn.geo_code(geo).alias("country_code"),
        F.col("gdp").alias("gdp_per_capita"),
        fn.to_ratio(F.col("penetration_pct")).alias("insurance_penetration"),
        fn.safe_ratio(F.col("displaced"), F.col("population")).alias("natural_disaster_exposure"),
        F.col("population"),
        F.col("displaced").alias("disaster_displaced_persons"),
    )


def country_risk(timeseries: DataFrame, markets: dict[str, str] = vocab.MARKETS) -> DataFrame:
    """At most one row per market."""
    return risk_columns(risk_pivot(latest_value(scan_timeseries(timeseries, markets))), markets)


def indicators(risk: DataFrame) -> DataFrame:
    exposure = fn.to_percent(F.col("natural_disaster_exposure"))
    return risk.select(
        "country",
        "country_code",
        fn.to_percent(F.col("insurance_penetration")).alias("insurance_penetration_pct"),
        F.col("gdp_per_capita").alias("gdp_per_capita_ppp"),
        F.coalesce(exposure, F.lit(0.0)).alias("disaster_exposure_pct"),
    )


def scale_rates(risk: DataFrame) -> DataFrame:
    return risk.select(
        "country",
        fn.to_percent(F.col("insurance_penetration"), 1).alias("ins_pct"),
        F.round("gdp_per_capita", 0).alias("gdp"),
        fn.to_percent(F.col("natural_disaster_exposure"), 1).alias("disaster_pct"),
        fn.to_millions(F.col("population")).alias("pop_m"),
    )


def risk_profile(risk: DataFrame) -> DataFrame:
    """Rounded profile, largest rounded GDP first; a missing exposure reads as zero."""
    filled = F.coalesce(F.col("disaster_pct"), F.lit(0.0))
    return (
        scale_rates(risk)
        .withColumn("disaster_pct", filled)
        .orderBy(F.col("gdp").desc_nulls_first(), "country")
    )


def indicators_view(table: DataFrame) -> DataFrame:
    return table.select(
        "country",
        "country_code",
        F.col("insurance_penetration_pct").alias("ins_pct"),
        F.col("gdp_per_capita_ppp").alias("gdp"),
        F.coalesce("disaster_exposure_pct", F.lit(0.0)).alias("disaster_pct"),
    ).orderBy(F.col("gdp").desc_nulls_first(), "country")


def risk_by_population(risk: DataFrame) -> DataFrame:
    return risk.select(
        "country",
        "country_code",
        "gdp_per_capita",
        "insurance_penetration",
        F.coalesce("natural_disaster_exposure", F.lit(0.0)).alias("disaster_exp"),
        "population",
        F.coalesce("disaster_displaced_persons", F.lit(0.0)).alias("displaced"),
    ).orderBy(F.col("population").desc_nulls_first(), "country")


def risk_profile_display(profile: DataFrame) -> DataFrame:
    """The profile as report text."""
    return profile.select(
        F.col("country").alias("Country"),
        fn.percent_text(F.col("ins_pct")).alias("Ins %"),
        fn.dollars(F.col("gdp")).alias("GDP/Cap"),
        fn.percent_text(F.col("disaster_pct")).alias("Disaster %"),
        F.format_number("pop_m", 1).alias("Pop (M)"),
    )


def indicators_display(view: DataFrame) -> DataFrame:
    return view.select(
        F.col("country").alias("Country"),
        F.col("country_code").alias("Code"),
        fn.percent_text(F.col("ins_pct")).alias("Insurance %"),
        fn.dollars(F.col("gdp")).alias("GDP/Capita"),
        fn.percent_text(F.col("disaster_pct")).alias("Disaster %"),
    )


def risk_detail_display(detail: DataFrame) -> DataFrame:
    return detail.select(
        F.col("country").alias("Country"),
        F.col("country_code").alias("Code"),
        fn.dollars(F.col("gdp_per_capita")).alias("GDP/Cap"),
        fn.percent_text(fn.to_percent(F.col("insurance_penetration"))).alias("Ins Pen"),
        fn.percent_text(fn.to_percent(F.col("disaster_exp"))).alias("Disaster Exp"),
        fn.whole_number(F.col("population")).alias("Population"),
        fn.whole_number(F.col("displaced")).alias("Displaced"),
    )
