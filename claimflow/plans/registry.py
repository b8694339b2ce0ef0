"""The registered queries: each operator over the whole given tables."""

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimflow import vocab
from claimflow.functions import responses, scalars as fn
from claimflow.operators import claims as views
from claimflow.operators import clusters, curate, decisions, kpis, notes, postings, quality, repair, risk, search, semantic
from claimflow.plans import bindings as b
from claimflow.session import scratch
from claimflow.sources import buckets, generate, tables, texts
from claimflow.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the vector and text searches: probe vectors by rule, and the sample questions.
PROBES = [(q, [math.cos((q + 1) * (i + 1)) for i in range(64)]) for q in range(5)]
QUESTIONS = list(enumerate(vocab.SAMPLE_QUESTIONS))
# Claims, policies or notes per note file: the files grow in number with the data, not in length.
KEYS_PER_FILE = 5_000


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and whole numbers as bigints, so that results compare across engines."""
    as_type = {"byte": "bigint", "short": "bigint", "integer": "bigint"}
    columns = []
    for f in df.schema.fields:
        name = f.dataType.typeName()
        target = "double" if name == "decimal" else as_type.get(name)
        column = F.col(f"`{f.name}`")
        columns.append(column.cast(target).alias(f.name) if target else column)
    return df.select(*columns)


def register(name: str):
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
        return query

    return add


def _over(source: Callable[[SparkSession, str], DataFrame]):
    """Register helper for operators that take one bound table."""

    def wrap(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
        register(name)(lambda spark, sf_dir: operator(source(spark, sf_dir)))

    return wrap


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _claims_with_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide claims plus population and displaced persons; both joins read one aggregate."""
    table = b.country_risk(spark, sf_dir)
    wide = curate.build_curated_claims(
        b.raw_claims(spark, sf_dir), b.raw_customers(spark, sf_dir), b.raw_policies(spark, sf_dir), table, markets_only=True
    )
    return curate.with_country_risk(wide, table, markets_only=True)


on_claims = _over(b.claims)
on_full_claims = _over(lambda s, d: b.claims(s, d, with_risk=True))
on_gapped = _over(b.gapped_claims)
on_evaluated = _over(b.evaluated_claims)
on_series = _over(b.timeseries)
on_risk = _over(b.country_risk)


def _shown(df: DataFrame, column: str = "score") -> DataFrame:
    """Scores rank and filter unrounded; what is shown has six digits."""
    return df.withColumn(column, F.round(column, 6))


# --- sources and sinks -----------------------------------------------------------------------------


@register("ingest_claims_stream")
def _ingest(spark, sf_dir):
    root = scratch(spark, "ingest")
    b.raw_claims(spark, sf_dir).write.json(f"{root}/in")
    ingested = jobs.ingest_claims(spark, f"{root}/in", f"{root}/raw", f"{root}/checkpoint")
    return jobs.raw_claims(ingested)


def _write_lines(lines: DataFrame, folder: str) -> None:
    """One file per kind and range of keys, in a folder named after both, lines by key."""
    dealt = lines.withColumn("part", F.floor(F.col("key") / KEYS_PER_FILE)).repartition("kind", "part")
    dealt.sortWithinPartitions("kind", "part", "key").drop("key").write.partitionBy("kind", "part").text(folder)


def _per_file(whole: DataFrame) -> DataFrame:
    """One row per file: its kind and part by its path, its lines and a hash of its text."""
    return whole.select(
        F.url_decode(F.regexp_extract("file_path", "kind=([^/]*)/", 1)).alias("kind"),
        F.regexp_extract("file_path", "part=([^/]*)/", 1).cast("bigint").alias("part"),
        (F.col("file_name") == F.element_at(F.split("file_path", "/"), -1)).alias("named"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"),
        F.md5("text").alias("text_md5"),
    )


@register("read_notes")
def _read_notes(spark, sf_dir):
    folder = scratch(spark, "notes")
    claims = b.raw_claims(spark, sf_dir)
    line = F.concat("claim_id", F.lit(" "), "description")
    _write_lines(claims.select(F.col("claim_type").alias("kind"), b.claim_key().alias("key"), line.alias("value")), folder)
    return _per_file(texts.read_notes(spark, folder))


@register("read_policy_docs")
def _read_policy_docs(spark, sf_dir):
    folder = scratch(spark, "policies")
    docs = curate.build_policy_text(b.raw_policies(spark, sf_dir))
    key = F.substring("policy_number", 5, 20).cast("bigint").alias("key")
    _write_lines(docs.select(F.col("policy_type").alias("kind"), key, F.col("search_text").alias("value")), folder)
    return _per_file(texts.read_policy_docs(spark, folder))


@register("materialize_risk")
def _materialize_risk(spark, sf_dir):
    return tables.write_snapshot(b.country_risk(spark, sf_dir), scratch(spark, "risk"))


@register("apply_decisions")
def _apply(spark, sf_dir):
    parsed = decisions.parse_decisions(b.responses(spark, sf_dir))
    done = decisions.apply_decisions(b.claims(spark, sf_dir), parsed)
    return done.select("claim_id", "status", "ai_decision", "ai_reasoning", "claim_amount")


@register("write_back_versions")
def _versions(spark, sf_dir):
    """Two committed versions of the claims, parsed decisions between them; what has changed."""
    root = scratch(spark, "claims_versions")
    rows = b.claims(spark, sf_dir).select("claim_id", "status", "ai_decision", "ai_reasoning")
    before = tables.write_version(rows, root, first=True)
    parsed = decisions.parse_decisions(b.responses(spark, sf_dir))
    tables.write_version(decisions.apply_decisions(tables.read_version(spark, root, rows.schema), parsed), root)
    return decisions.version_changes(before, tables.read_version(spark, root, rows.schema))


def _bucketed(spark: SparkSession, sf_dir: str) -> str:
    """The claims stored by hash bucket; where."""
    root = scratch(spark, "claims_buckets")
    buckets.create(b.claims(spark, sf_dir), root)
    return root


@register("apply_decisions_bucketed")
def _apply_bucketed(spark, sf_dir):
    """The write-back over a table in buckets of the claim id: the claims are joined where they lie."""
    name = f"claims_{uuid.uuid4().hex}"
    claims = tables.write_bucketed(b.claims(spark, sf_dir), name, "claim_id", 16, scratch(spark, name))
    done = decisions.apply_decisions(claims, decisions.parse_decisions(b.responses(spark, sf_dir)))
    return done.select("claim_id", "status", "ai_decision", "ai_reasoning", "claim_amount")


@register("write_back_buckets")
def _write_back(spark, sf_dir):
    """The stored claims after a write-back of all parsed decisions."""
    root = _bucketed(spark, sf_dir)
    buckets.apply(spark, root, decisions.parse_decisions(b.responses(spark, sf_dir)))
    return buckets.read(spark, root).select("claim_id", "status", "ai_decision", "ai_reasoning", "claim_amount")


@register("stored_claim_by_id")
def _stored_claim(spark, sf_dir):
    return buckets.by_id(spark, _bucketed(spark, sf_dir), "CLM-7").select("claim_id", "status", "claim_amount")


@register("export_csv")
def _export(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = b.claims(spark, sf_dir).select("claim_id", "claim_type", "country", "city", "claim_amount", "description")
    tables.export_csv(rows, F.col("claim_amount") > 250_000, path)
    return tables.read_csv(spark, rows.schema, path)


register("generate_customers")(lambda s, d: generate.generate_customers(b.table(s, d, "customer"), "c_custkey"))
register("generate_policies")(lambda s, d: generate.generate_policies(b.table(s, d, "customer"), "c_custkey"))
register("generate_claims")(lambda s, d: generate.generate_claims(b.table(s, d, "orders"), "o_orderkey"))


@register("generated_rule_breaks")
def _generated_breaks(spark, sf_dir):
    seeds = b.table(spark, sf_dir, "orders")
    policies = generate.generate_policies(seeds, "o_orderkey").select("policy_number", "policy_type")
    rows = generate.generate_claims(seeds, "o_orderkey").join(policies, "policy_number", "left")
    return quality.violation_counts(rows)


on_full_claims("scan_claims", views.scan_claims)
on_series("scan_timeseries", lambda df: risk.scan_timeseries(df).select("geo_id", "variable_name", "date", "value"))
on_full_claims("dataset_claims", tables.dataset_claims)
on_risk("dataset_risk", tables.dataset_risk)
_over(b.note_texts)("dataset_notes", lambda df: notes.dataset_notes(notes.extract_notes(df)))

# --- projections, filters, predicates --------------------------------------------------------------

on_claims("filter_claim_by_id", lambda df: views.by_id(df, "CLM-7").select("claim_id", "status", "claim_amount"))
on_claims("filter_pending", lambda df: views.pending(df).select("claim_id", "country", "claim_amount"))
on_series("filter_in_markets", lambda df: risk.filter_in_markets(df).select("geo_id", "variable", "date"))
on_series("geo_to_country", lambda df: df.select("geo_id", "date", fn.geo_to_country(F.col("geo_id")).alias("country")))
on_risk("scale_rates", risk.scale_rates)
on_series(
    "exposure_ratio",
    lambda df: risk.risk_pivot(risk.latest_value(df.filter("value IS NOT NULL"))).select(
        "geo_id", fn.safe_ratio(F.col("displaced"), F.col("population")).alias("exposure")
    ),
)
on_risk(
    "coalesce_exposure",
    lambda df: df.select(
        "country",
        F.coalesce(fn.to_percent(F.col("natural_disaster_exposure"), 1), F.lit(0.0)).alias("disaster_pct"),
        F.coalesce("disaster_displaced_persons", F.lit(0.0)).alias("displaced"),
    ),
)
on_evaluated(
    "decision_to_status",
    lambda df: df.select("claim_id", fn.decision_to_status(F.col("ai_decision")).alias("new_status")),
)


@register("risk_band")
def _risk_band(spark, sf_dir):
    score = F.col("risk_score")
    return decisions.parse_decisions(b.responses(spark, sf_dir), on_error="ERROR").select(
        "claim_id", "risk_score", fn.risk_points(score).alias("points"),
        fn.risk_band(score).alias("band"), fn.risk_percent(score).alias("pct"),
    )


@register("relevance_band")
def _relevance_band(spark, sf_dir):
    return _shown(search.with_relevance(search.best_question(b.documents(spark, sf_dir), QUESTIONS))).select(
        "doc_id", "score", "relevance"
    )


on_gapped("claim_labels", views.labels)
on_gapped("claim_headline", views.headline)
on_gapped("claim_detail_unpivot", views.detail_rows)
on_claims("claim_type_mismatch", quality.claim_type_mismatch)
on_claims("description_violations", quality.description_violations)
on_claims("description_violations_full", quality.description_violations_by_rule)
on_evaluated("unevaluated_claims", lambda df: views.unevaluated(df).select("claim_id", "ai_decision"))
_over(_claims_with_risk)("market_context", views.market_context)
on_full_claims(
    "procedure_context",
    lambda df: _rounded(
        views.procedure_context(df).select("claim_id", "gdp", "penetration_pct", "exposure_pct"),
        6, "gdp", "penetration_pct", "exposure_pct",
    ),
)
_over(lambda s, d: b.gapped_claims(s, d, with_risk=True))("render_prompts", views.render_prompts)


@register("display_projection")
def _display(spark, sf_dir):
    return risk.risk_profile_display(risk.risk_profile(b.country_risk(spark, sf_dir)))


on_risk("indicators_display", lambda df: risk.indicators_display(risk.indicators_view(risk.indicators(df))))
on_risk("risk_detail_display", lambda df: risk.risk_detail_display(risk.risk_by_population(df)))
on_claims("top_claims_display", lambda df: views.largest_display(views.largest(df)))
on_evaluated("kpi_display", lambda df: kpis.kpi_display(kpis.kpi_rollup(df)))

# --- joins -----------------------------------------------------------------------------------------

_over(_claims_with_risk)(
    "claims_with_risk",
    lambda df: df.select("claim_id", "country", "claim_amount", "population", "disaster_displaced_persons"),
)
_over(_claims_with_risk)("load_claims", views.load_claims)
on_full_claims("build_curated_claims", lambda df: df)


@register("decisions_onto_claims")
def _onto(spark, sf_dir):
    parsed = decisions.parse_decisions(b.responses(spark, sf_dir))
    return decisions.decisions_onto_claims(b.raw_claims(spark, sf_dir).select("claim_id", "status"), parsed).select(
        "claim_id", "status", "new_decision"
    )


on_claims("mismatch_anti_join", quality.mismatch_anti_join)
on_claims(
    "names_by_country", lambda df: repair.names_by_country(df).select("claim_id", "country", "surname")
)
_over(b.documents)("query_doc_join", lambda df: _shown(search.best_question(df, QUESTIONS)))

# --- aggregations ----------------------------------------------------------------------------------

on_evaluated("kpi_rollup", kpis.kpi_rollup)
on_evaluated("evaluation_progress", lambda df: kpis.evaluation_progress(kpis.kpi_rollup(df)))
on_claims("claims_by_type", lambda df: kpis.count_by(df, "claim_type"))
on_claims("claims_by_status", lambda df: kpis.count_by(df, "status"))
on_claims("claims_by_country", lambda df: kpis.count_by(df, "country"))
on_claims("claim_ids_by_type", lambda df: kpis.count_ids_by(df, "claim_type"))
on_claims("claim_ids_by_status", lambda df: kpis.count_ids_by(df, "status"))
on_claims("amount_by_country", lambda df: kpis.total_by(df, "country", "claim_amount", "total_amount"))
on_claims("bi_kpis", lambda df: _rounded(kpis.bi_kpis(df), 2, "average_claim"))
on_claims("top_claims_grouped", kpis.claims_by_amount)
on_risk("gdp_by_country", lambda df: kpis.average_by(df, "country", "gdp_per_capita", "avg_gdp"))
on_risk("penetration_by_country", lambda df: kpis.average_by(df, "country", "insurance_penetration", "avg_penetration"))
on_risk("exposure_by_country", lambda df: kpis.average_by(df, "country", "natural_disaster_exposure", "avg_exposure"))
on_risk("country_risk_detail", kpis.country_risk_detail)
on_series("risk_pivot", lambda df: risk.risk_pivot(risk.latest_value(df.filter("value IS NOT NULL"))))
on_claims("violation_counts", quality.violation_counts)
on_claims(
    "avg_amount_nat_disaster_by_country",
    lambda df: _rounded(
        kpis.average_amount_of_type(repair.repair_claim_types(df), "Natural Disaster"), 2, "avg_amount"
    ),
)
on_claims("city_most_medical", lambda df: kpis.busiest_city(df, "Medical"))
on_claims("pending_count", kpis.pending_count)
on_claims("country_highest_total", kpis.country_highest_total)
on_claims("count_by_policy_type", lambda df: kpis.count_by(df, "policy_type"))
on_claims("type_share_by_country", lambda df: _rounded(kpis.type_share(df, "Medical"), 4, "share_pct"))
on_claims(
    "type_share_in_country",
    lambda df: _rounded(kpis.type_share_in_country(df, "Medical", "Singapore"), 4, "share_pct"),
)
on_claims("premium_vs_claim_by_country", lambda df: _rounded(kpis.premium_vs_claim(df), 2, "avg_premium", "avg_claim"))
on_full_claims(
    "semantic_query",
    lambda df: _rounded(
        semantic.semantic_query(
            df,
            ["market", "product"],
            ["amount", "excess", "max coverage", "annual premium", "income", "claim number", ("town", "DISTINCT_COUNT")],
            {"stage": ["Pending", "Submitted"]},
        ),
        2, "average_deductible", "average_coverage_limit", "average_country_gdp_per_capita",
    ),
)

# --- windows, sorts, limits, set operations --------------------------------------------------------

on_series("latest_value", lambda df: risk.latest_value(risk.scan_timeseries(df)))
_over(b.documents)("ranked_hits", lambda df: search.search_text(df, QUESTIONS).select("query_id", "rank", "doc_id"))
on_claims("claims_ordered", lambda df: views.ordered(df).select("claim_id", "status", "claim_amount"))
on_claims("top10_claims", views.largest)
on_risk("risk_profile", risk.risk_profile)
on_risk("indicators_view", lambda df: risk.indicators_view(risk.indicators(df)))
on_risk("risk_by_population", risk.risk_by_population)
_over(b.documents)("search_topk", lambda df: _shown(search.search_text(df, QUESTIONS, k=3)))


@register("row_count_gate")
def _row_counts(spark, sf_dir):
    risk_table = b.country_risk(spark, sf_dir)
    return quality.row_count_gate(
        {
            "raw_customers": b.raw_customers(spark, sf_dir),
            "raw_policies": b.raw_policies(spark, sf_dir),
            "raw_claims": b.raw_claims(spark, sf_dir),
            "claims": b.claims(spark, sf_dir),
            "country_risk": risk_table,
            "indicators": risk.indicators(risk_table),
        },
        vocab.EXPECTED_ROWS,
    )


# --- text, decisions, search -----------------------------------------------------------------------

_over(b.note_texts)("extract_notes", notes.extract_notes)
_over(b.note_texts)("itemized_totals", notes.itemized_totals)
_over(b.responses)("parse_decisions", lambda df: decisions.parse_decisions(df).drop("response"))
_over(b.responses)(
    "parse_decisions_strict", lambda df: decisions.parse_decisions(df, on_error="ERROR").drop("response")
)
on_evaluated("previous_evaluation", decisions.previous_evaluation)
on_claims("evaluate_rules", lambda df: decisions.evaluate(df).select("claim_id", "decision", "reasoning"))
on_claims("recommended_payout", lambda df: decisions.evaluate(df).select("claim_id", "recommended_payout"))
on_full_claims("risk_score", lambda df: decisions.evaluate(df).select("claim_id", "risk_score"))
on_full_claims(
    "batch_evaluate_pending",
    lambda df: decisions.batch_evaluate_pending(df).select(
        "claim_id", "status", "ai_decision", "ai_reasoning", "claim_amount"
    ),
)
on_full_claims("evaluate_claim", lambda df: decisions.evaluate_claim(df, "CLM-7"))
on_full_claims("evaluation_display", lambda df: decisions.evaluation_display(decisions.evaluate(df)))
on_full_claims("status_transitions", decisions.status_transitions)
_over(b.gapped_policies)("build_policy_text", curate.build_policy_text)
_over(b.vectors)("search_vectors", lambda df: _shown(search.search_vectors(df, PROBES)))


@register("search_vectors_clustered")
def _clustered(spark, sf_dir):
    """search_vectors by the clusters that can hold a hit."""
    root = scratch(spark, "clusters")
    clusters.write_clusters(b.vectors(spark, sf_dir), root)
    return _shown(clusters.search_clusters(spark, root, PROBES))


_over(b.documents)("search_text", lambda df: _shown(search.with_relevance(search.search_text(df, QUESTIONS))))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the sample questions with their documents."""
    docs = b.documents(spark, sf_dir)
    return search.with_documents(search.search_text(docs, QUESTIONS), docs)


_over(_found)("assemble_context", search.assemble_context)
_over(_found)("search_display", search.hit_display)
_over(_found)("search_response", lambda df: _shown(search.read_search_response(search.search_response(df))))


@register("search_text_indexed")
def _indexed(spark, sf_dir):
    """search_text by the lists of the asked terms alone."""
    root = scratch(spark, "index")
    postings.write_index(b.stored_documents(spark, sf_dir), root)
    asked = spark.createDataFrame(QUESTIONS, "query_id bigint, question string")
    hits = postings.search_index(spark, root, asked, terms=postings.terms_in(QUESTIONS))
    return _shown(search.with_relevance(hits))


@register("question_table_search")
def _question_table(spark, sf_dir):
    """The best documents for what each conversation opens with: questions that come as a table."""
    root = scratch(spark, "index")
    postings.write_index(b.stored_documents(spark, sf_dir), root)
    opened = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    asked = opened.select(F.col("conv_id").alias("query_id"), "question")
    return _shown(postings.search_index(spark, root, asked)).select("query_id", "rank", "doc_id", "score")


@register("clean_completion")
def _clean(spark, sf_dir):
    quoted = F.concat(
        F.lit(' "'), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\\tcost $5"), F.lit('"\n')
    )
    rows = b.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", responses.clean_completion(quoted).alias("answer"))


@register("policy_search")
def _policy_search(spark, sf_dir):
    """The sample questions over the texts of the policies, whose ids are policy numbers."""
    docs = curate.build_policy_text(b.raw_policies(spark, sf_dir)).selectExpr(
        "policy_number AS doc_id", "policy_type AS doc_type", "search_text AS text"
    )
    hits = search.with_documents(search.search_text(docs, QUESTIONS), docs)
    return _shown(search.read_search_response(search.search_response(hits)))


# One question more, which no document answers.
ASKED = [*QUESTIONS, (len(QUESTIONS), "qqqzzzx")]
_over(b.documents)(
    "search_quality_gate",
    lambda df: _shown(search.search_quality_gate(search.search_text(df, ASKED), [q for q, _ in ASKED]), "best_score"),
)


# --- streaming and repair --------------------------------------------------------------------------


def _decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All responses through the stream, and for each a second record that breaks off."""
    root = scratch(spark, "decisions")
    whole = F.to_json(F.struct("claim_id", "decided_at", "response"))
    broken = F.concat(F.lit('{"claim_id": "'), F.col("claim_id"), F.lit('"'))
    b.responses(spark, sf_dir).select(F.explode(F.array(whole, broken)).alias("value")).write.text(f"{root}/in")
    return jobs.log_decisions(spark, f"{root}/in", f"{root}/log", f"{root}/checkpoint")


@register("stream_status_counts")
def _stream_counts(spark, sf_dir):
    return jobs.stream_status_counts(b.claims(spark, sf_dir), _decision_log(spark, sf_dir))


@register("compacted_status_counts")
def _compacted_counts(spark, sf_dir):
    """Claims per status in the stored table that the log has been written back into; the log is not read."""
    root = _bucketed(spark, sf_dir)
    where = f"{scratch(spark, 'log')}"
    whole = F.to_json(F.struct("claim_id", "decided_at", "response"))
    b.responses(spark, sf_dir).select(whole.alias("value")).write.text(f"{where}/in")
    jobs.log_decisions(spark, f"{where}/in", f"{where}/log", f"{where}/read")
    jobs.compact_decisions(spark, f"{where}/log", root, f"{where}/applied")
    return kpis.count_by(buckets.read(spark, root), "status")


@register("ingest_notes_stream")
def _ingest_notes(spark, sf_dir):
    """Every note through the stream; a file holds many, which are cut apart at their first line."""
    folder = scratch(spark, "note_files")
    # A task holds a file whole: they grow in number with the notes, not in length.
    lines = b.note_texts(spark, sf_dir).select(F.col("text").alias("value"))
    lines.write.option("maxRecordsPerFile", KEYS_PER_FILE).text(f"{folder}/in")
    ingested = jobs.ingest_notes(spark, f"{folder}/in", f"{folder}/notes", f"{folder}/checkpoint", opening="FIELD INSPECTION REPORT")
    return jobs.noted(ingested).drop("file_name")


@register("malformed_decisions")
def _malformed(spark, sf_dir):
    return jobs.malformed_decisions(_decision_log(spark, sf_dir)).select(F.col(jobs.MALFORMED).alias("record"))


on_claims("hash_bucket", lambda df: repair.hash_buckets(df, 7))
on_claims(
    "repair_claim_types",
    lambda df: repair.repair_claim_types(df).select("claim_id", "policy_type", "claim_type"),
)
on_claims(
    "repair_descriptions",
    lambda df: repair.repair_descriptions(repair.repair_claim_types(df)).select("claim_id", "description"),
)
on_claims("repair_names", lambda df: repair.repair_names(df).select("claim_id", "country", "last_name"))


@register("reset_evaluations")
def _reset(spark, sf_dir):
    evaluated = decisions.batch_evaluate_pending(b.evaluated_claims(spark, sf_dir))
    return repair.reset_evaluations(evaluated).select("claim_id", "status", "ai_decision", "ai_reasoning")


@register("status_gate")
def _status_gate(spark, sf_dir):
    closed = decisions.batch_evaluate_pending(b.claims(spark, sf_dir))
    return quality.status_gate(closed.withColumn("ai_decision", F.lit(None).cast("string")))


on_claims("market_coverage_gate", quality.market_coverage_gate)
on_claims("name_country_gate", quality.name_country_gate)


@register("build_gates")
def _build_gates(spark, sf_dir):
    """What the gates find, counted by the write of the claims table itself."""
    checked, seen = quality.observed(b.claims(spark, sf_dir))
    tables.write_snapshot(checked, scratch(spark, "gated"))
    return quality.gate_figures(spark, seen)
