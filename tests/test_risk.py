"""Newest value, pivot and country risk on hand-made series."""

import datetime as dt

from claimflow import schemas
from claimflow.operators import curate, risk

D1, D2 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
GDP = "GDP per capita, PPP (current international $)"
DISPLACED = "Internally displaced persons, disasters"


def series(spark, rows):
    return spark.createDataFrame([(g, "v", n, d, v, "u") for g, n, d, v in rows], schemas.TIMESERIES)


def test_newest_row(spark):
    df = series(spark, [
        ("country/JPN", "a", D1, 1.0), ("country/JPN", "a", D2, 2.0),
        ("country/JPN", "b", D2, 3.0), ("country/JPN", "b", None, 4.0),
        ("country/JPN", "c", D1, 5.0), ("country/JPN", "c", D1, 7.0), ("country/JPN", "c", D1, 6.0),
        ("country/JPN", "d", D1, 8.0), ("country/JPN", "d", D2, None),
        ("country/JPN", "e", D1, None), ("country/USA", "a", D1, 9.0),
    ])
    newest = risk.latest_value(risk.scan_timeseries(df))
    assert {(r.variable_name, r.value) for r in newest.collect()} == {("a", 2.0), ("b", 4.0), ("c", 7.0), ("d", 8.0)}


def test_larger_of_several_matching_names_wins(spark):
    df = series(spark, [
        ("country/JPN", GDP, D2, 10.0), ("country/JPN", "old gdp PER CAPITA ppp CURRENT INTERNATIONAL", D1, 20.0),
        ("country/JPN", DISPLACED, D1, 5.0), ("country/JPN", "Population, total", D2, 50.0),
        ("country/HKG", DISPLACED, D1, 5.0), ("country/HKG", "Population, total", D2, 0.0),
        ("country/SGP", "population, TOTAL", D2, 3.0),
    ])
    rows = {r.country: r for r in risk.country_risk(df).collect()}
    assert rows["Japan"].gdp_per_capita == 20.0 and rows["Japan"].natural_disaster_exposure == 0.1
    assert rows["Hong Kong"].natural_disaster_exposure is None
    assert rows["Singapore"].population is None
    table = {r.country: r.disaster_exposure_pct for r in risk.indicators(risk.country_risk(df)).collect()}
    assert table == {"Japan": 10.0, "Hong Kong": 0.0, "Singapore": 0.0}


def test_missing_gdp_sorts_first(spark):
    df = series(spark, [("country/JPN", GDP, D1, 1.0), ("country/SGP", DISPLACED, D1, 1.0), ("country/HKG", GDP, D1, 2.0)])
    profile = risk.risk_profile(risk.country_risk(df))
    assert [r.country for r in profile.collect()] == ["Singapore", "Hong Kong", "Japan"]


def test_every_claim_survives_the_joins(spark, sf_dir):
    claims = spark.createDataFrame(
        [("1", "P1", "Fire", "Pending", D1, None, "x"), ("2", None, "Fire", "Pending", D1, None, "x"),
         ("3", "P9", "Fire", "Pending", D1, None, "x"), ("4", "P2", "Fire", "Pending", D1, None, "x")],
        schemas.RAW_CLAIMS)
    policies = spark.createDataFrame([("P1", "C1", "Home", None, None, None), ("P2", "C9", "Home", None, None, None)],
                                     schemas.RAW_POLICIES)
    customers = spark.createDataFrame([("C1", "A", "B", "Japan", "Tokyo")], schemas.RAW_CUSTOMERS)
    table = spark.createDataFrame([("Japan", "JPN", 1.0, 2.0, 3.0, 4.0, 5.0)], schemas.COUNTRY_RISK)
    wide = curate.build_curated_claims(claims, customers, policies, table)
    rows = {r.claim_id: r for r in wide.collect()}
    assert wide.columns == schemas.names(schemas.CLAIMS) and len(rows) == 4
    assert rows["1"].country_gdp_per_capita == 1.0 and rows["4"].policy_type == "Home" and rows["4"].country is None
    assert rows["2"].policy_type is None and rows["3"].policy_type is None
    more = {r.claim_id: r.population for r in curate.with_country_risk(wide, table).collect()}
    assert more == {"1": 4.0, "2": None, "3": None, "4": None}
