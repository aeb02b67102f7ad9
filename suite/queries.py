"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import Settings
from plumbline.operators import claims as claim_ops
from plumbline.operators import compare, joins, problems, profile, report, sampling, verdicts
from plumbline.plans import check, run
from plumbline.sources import sizes
from plumbline.sources.catalog import declared_keys
from suite.inputs import (
    BRANCH_TARGETS,
    CLAIMS,
    CLICKS_SUPPLIER,
    CUSTOMER_SUPPLIER,
    EVENTS_SUPPLIER,
    LINENUMBER,
    LINES_ORDERS,
    ORDERS_CUSTOMER,
    PART_CUSTOMER,
    SETTINGS,
    SUSPICIONS,
    TEXT_FALLBACK,
    catalog,
    mixed_case,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NUMBERS = ["total", "nulls", "hits", "orphans", "hit", "orphans_above", "orphans_below"]
VERDICT = ["claim_id", *NUMBERS, "candidates", "also_fits", "skipped", "empty", "status"]
PROBLEM = [
    "claim_id", "over", "exact", "row_count", "age_days", "distinct_values", "canonical_forms", "collisions", "total", "matched",
    "shared_columns", "overlap", "total_reverse", "matched_reverse", "overlap_reverse", "has_primary_key", "skipped", "empty", "status",
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- joins ----


def _hit_rate(claim: joins.Relationship) -> Query:
    return lambda spark, sf: joins.join_hit_rate(catalog(spark, sf), claim)


QUERIES["join_hit_rate_orders_customer"] = _hit_rate(ORDERS_CUSTOMER)
QUERIES["join_broken_part_customer"] = _hit_rate(PART_CUSTOMER)
QUERIES["join_rejected_customer_supplier"] = _hit_rate(CUSTOMER_SUPPLIER)
QUERIES["join_when_click_events_supplier"] = _hit_rate(CLICKS_SUPPLIER)
QUERIES["join_text_fallback"] = _hit_rate(TEXT_FALLBACK)
QUERIES["join_keyed_lineitem_orders"] = _hit_rate(LINES_ORDERS)


@query
def orphan_rows_part_customer(spark, sf):
    return joins.orphan_rows(catalog(spark, sf), PART_CUSTOMER)


@query
def orphan_rows_lines_customer(spark, sf):
    lines = joins.Relationship("lineitem", "l_partkey", "customer", "c_custkey")
    return joins.orphan_rows(catalog(spark, sf), lines, spread=True).select(*SAMPLE_KEY)


@query
def orphan_placement_events_supplier(spark, sf):
    return joins.orphan_placement(catalog(spark, sf), EVENTS_SUPPLIER)


@query
def join_by_event_type(spark, sf):
    return joins.join_hit_rate_by_branch(catalog(spark, sf), EVENTS_SUPPLIER, "event_type").select("branch", "total", "nulls", "hits", "orphans", "hit")


@query
def join_by_event_type_targets(spark, sf):
    return joins.join_hit_rate_by_branch(catalog(spark, sf), EVENTS_SUPPLIER, "event_type", targets=BRANCH_TARGETS)


@query
def dense_keys(spark, sf):
    return joins.dense_keys(catalog(spark, sf), SETTINGS).select("table", "column", "rows", "lo", "hi")


def _decided(spark, sf, claims, **how):
    measured = joins.measure_relationships(catalog(spark, sf), claims, SETTINGS, **how)
    return verdicts.decide(measured, SETTINGS)


@query
def weak_evidence_linenumber(spark, sf):
    return _decided(spark, sf, [LINENUMBER]).select("claim_id", "total", "hits", "candidates", "also_fits", "status")


@query
def measure_claims_all(spark, sf):
    return _decided(spark, sf, CLAIMS).select(*VERDICT)


@query
def measure_claims_long_form(spark, sf):
    return _decided(spark, sf, CLAIMS, spread=True).select(*VERDICT)


@query
def measure_join_single(spark, sf):
    return run.measure_join(catalog(spark, sf), "Part", "p_partkey", "default.CUSTOMER", "c_custkey", SETTINGS).select(
        "claim_id", *NUMBERS, "status", "line"
    )


# ---- profiles ----

PROFILE = ["table", "ordinal", "column", "nullable", "family", "rows", "non_null", "null_rate", "distinct"]


@query
def profile_all(spark, sf):
    return profile.table_profile(catalog(spark, sf), SETTINGS).select(*PROFILE)


@query
def profile_values_all(spark, sf):
    told = profile.table_profile(catalog(spark, sf), SETTINGS, values=True).where("values IS NOT NULL AND family <> 'time'")
    return told.where("type <> 'double'").select("table", "column", "distinct", F.array_join("values", ", ").alias("values"))


@query
def profile_orders(spark, sf):
    return profile.table_profile(catalog(spark, sf).only(["orders"]), SETTINGS).select(*PROFILE, "max_length", "categorical", "visible")


@query
def profile_text_lengths(spark, sf):
    return profile.table_profile(catalog(spark, sf), SETTINGS).where("family = 'text'").select("table", "column", "distinct", "max_length")


@query
def profile_customer_categorical(spark, sf):
    return profile.table_profile(catalog(spark, sf).only(["customer"]), SETTINGS).where("categorical").select("column", "distinct")


@query
def visibility_all(spark, sf):
    return profile.table_profile(catalog(spark, sf), SETTINGS).select("table", "column", "categorical", "visible")


@query
def year_ranges(spark, sf):
    return profile.table_profile(catalog(spark, sf), SETTINGS).where("year_min IS NOT NULL").select("table", "column", "year_min", "year_max")


@query
def describe_part(spark, sf):
    return profile.describe_table(catalog(spark, sf), "part", SETTINGS).withColumn("values", F.array_join("values", ", "))


def _value_lists(cat, tables):
    some = cat.only(tables)
    categorical = profile.listed_columns(profile.table_profile(some, SETTINGS), "categorical")
    return profile.value_lists(some, SETTINGS, categorical)


@query
def value_lists_lineitem(spark, sf):
    return _value_lists(catalog(spark, sf), ["lineitem"]).select("column", F.array_join("values", ", ").alias("values"))


@query
def redacted_sample_customer(spark, sf):
    cat = catalog(spark, sf)
    visible = {c for _, c in profile.listed_columns(profile.table_profile(cat.only(["customer"]), SETTINGS), "visible")}
    return profile.redacted_sample(cat, "customer", SETTINGS, visible)


# ---- sizes and samples ----


@query
def row_counts(spark, sf):
    return sizes.row_counts(catalog(spark, sf))


@query
def pilot_estimate(spark, sf):
    return sizes.pilot_row_estimate(catalog(spark, sf)["lineitem"], SETTINGS)


@query
def partition_estimate(spark, sf):
    cat = catalog(spark, sf)
    parts = [sizes.parts_of(cat[t], SETTINGS) for t in ("documents", "lineitem", "orders", "events")]
    return sizes.partition_estimate(reduce(DataFrame.unionAll, parts))


def _sample(spark, sf):
    return sampling.repeatable_sample(catalog(spark, sf)["lineitem"].df, 0.1, SETTINGS.sample_seed, SAMPLE_KEY)


@query
def repeatable_sample_lineitem(spark, sf):
    return _sample(spark, sf).select(*SAMPLE_KEY)


@query
def sample_cap_lineitem(spark, sf):
    return sampling.sample_cap(catalog(spark, sf)["orders"].df, 100, SETTINGS.sample_seed, ["o_orderkey"]).select("o_orderkey")


@query
def sample_fallback_size(spark, sf):
    orders = catalog(spark, sf)["orders"].df
    settings = Settings(sample_rows=500)
    rows, counted = sampling.first_rows(orders, settings).size(None, settings)
    return orders.limit(1).select(F.lit(rows).cast("bigint").alias("rows"), F.lit(counted).alias("is_count"))


@query
def join_on_sample_lineitem(spark, sf):
    return joins.join_hit_rate(catalog(spark, sf).replace(lineitem=_sample(spark, sf)), joins.Relationship("lineitem", "l_partkey", "customer", "c_custkey"))


SAMPLED = Settings(sampled=True, sample_rows=1000, as_of=SETTINGS.as_of)


@query
def profile_orders_sampled(spark, sf):
    return profile.table_profile(catalog(spark, sf).only(["orders"]), SAMPLED).select(*PROFILE)


@query
def claims_sampled(spark, sf):
    measured = joins.measure_relationships(catalog(spark, sf), [ORDERS_CUSTOMER], SAMPLED)
    return verdicts.decide(measured, SAMPLED).select(*VERDICT)


# ---- problems ----


def _problems(cat, suspicions):
    return verdicts.decide(problems.measure_suspicions(cat, suspicions, SETTINGS), SETTINGS)


@query
def dead_tables_as_of(spark, sf):
    return problems.dead_table(catalog(spark, sf), ["orders", "lineitem", "events", "customer", "archived"], SETTINGS)


@query
def inconsistent_values_docs(spark, sf):
    asked = [problems.Suspicion("inconsistent_values", (t,), c) for t, c in (("documents", "lang"), ("documents", "source"), ("events", "event_type"))]
    return _problems(mixed_case(catalog(spark, sf)), asked).select("claim_id", "distinct_values", "canonical_forms", "collisions", "status")


@query
def inconsistent_groups(spark, sf):
    groups = problems.inconsistent_groups(mixed_case(catalog(spark, sf)), [("documents", "lang"), ("events", "event_type")], SETTINGS)
    return groups.withColumn("spellings", F.array_join("spellings", "|"))


@query
def duplicate_overlap_documents(spark, sf):
    cat = catalog(spark, sf)
    scan = sampling.Scan.of(cat, SETTINGS)
    return problems.duplicate_overlap(scan, cat["documents"], cat["benchmark"], ["text"])


@query
def missing_keys(spark, sf):
    cat = catalog(spark, sf)
    return problems.missing_key(cat).join(sizes.row_counts(cat).withColumnRenamed("table", "name"), "name")


@query
def suspicions_all(spark, sf):
    return _problems(catalog(spark, sf), SUSPICIONS).select(*PROBLEM)


# ---- claims ----


@query
def declared_joins(spark, sf):
    cat = catalog(spark, sf)
    stated = claim_ops.claims_from_keys(cat.keys_df())
    copies = stated.withColumn("basis", F.lit("inferred")).withColumn("from_table", F.upper("from_table"))
    none = run.suspicions_df(cat, [])
    return run.verify(cat, stated.unionByName(copies), none, SETTINGS).select(*VERDICT)


@query
def branch_claims_events(spark, sf):
    cat = catalog(spark, sf)
    lists = _value_lists(cat, ["events"]).where("column = 'event_type'")
    branches = claim_ops.claims_from_values(lists, "events", "user_id", "supplier", "s_suppkey")
    return run.verify(cat, branches, run.suspicions_df(cat, []), SETTINGS).select(*VERDICT)


@query
def keys_declared(spark, sf):
    cat = catalog(spark, sf)
    return declared_keys(cat.keys_df()).join(sizes.row_counts(cat), "table", "right")


# ---- verdicts ----


def _all_verdicts(cat):
    return verdicts.decide(run.measure(cat, CLAIMS, SUSPICIONS, SETTINGS), SETTINGS)


@query
def verdict_summary(spark, sf):
    return verdicts.verdict_summary(_all_verdicts(catalog(spark, sf)))


@query
def broken_joins(spark, sf):
    return verdicts.broken_joins(_all_verdicts(catalog(spark, sf)))


@query
def empty_reasons(spark, sf):
    return verdicts.empty_reasons(_all_verdicts(catalog(spark, sf)))


@query
def has_findings(spark, sf):
    return verdicts.has_findings(_all_verdicts(catalog(spark, sf)))


@query
def relation_kinds(spark, sf):
    cat = catalog(spark, sf)
    kinds = verdicts.relation_kinds(cat.relations_df())
    rows = cat.relations_df().join(sizes.row_counts(cat), F.col("name") == F.col("table")).groupBy("kind").agg(F.sum("rows").alias("rows"))
    return kinds.join(rows, "kind")


# ---- two runs ----

KEPT_CLAIMS = CLAIMS
KEPT_SUSPICIONS = SUSPICIONS


def _kept(cat):
    rels, sus = run.prepared(cat, run.relationships_df(cat, KEPT_CLAIMS), run.suspicions_df(cat, KEPT_SUSPICIONS))
    before = verdicts.decide(run.measure(cat, KEPT_CLAIMS, KEPT_SUSPICIONS, SETTINGS), SETTINGS)
    return run.snapshot_of(cat, rels, sus, before, SETTINGS)


def moved(cat):
    """The tables some time later: one lost a segment, one was dropped, one lost a column, one is new."""
    customer = cat["customer"].df.where("c_mktsegment <> 'BUILDING'")
    return cat.replace(
        customer=customer, labels=None, documents=mixed_case(cat)["documents"].df,
        orders=cat["orders"].df.drop("o_orderpriority"), vip=customer,
    )


@query
def remeasure_unchanged(spark, sf):
    cat = catalog(spark, sf)
    found = check.check(cat, _kept(cat), SETTINGS)
    return compare.change_tally(found.changes, found.relations)


def _moved(spark, sf):
    cat = catalog(spark, sf)
    return check.check(moved(cat), _kept(cat), SETTINGS)


@query
def remeasure_moved(spark, sf):
    return _moved(spark, sf).changes


@query
def change_tally(spark, sf):
    found = _moved(spark, sf)
    return compare.change_tally(found.changes, found.relations)


@query
def gates(spark, sf):
    found = _moved(spark, sf)
    both = [compare.gate(found.changes, found.relations, g).select(F.lit(g).alias("fail_on"), "fails") for g in compare.FAILING]
    return both[0].unionAll(both[1]).unionAll(both[2])


@query
def change_rows(spark, sf):
    found = _moved(spark, sf)
    return report.change_rows(found.changes, found.relations)


@query
def relations_moved(spark, sf):
    cat = catalog(spark, sf)
    now = moved(cat)
    before, after = sizes.row_counts(cat), sizes.row_counts(now)
    both = before.unionByName(after).groupBy("table").agg(F.max("rows").alias("rows")).withColumnRenamed("table", "name")
    return compare.schema_diff(cat.relations_df(), now.relations_df()).join(both, "name")


# ---- findings ----


def _told(cat):
    rels, sus = run.prepared(cat, run.relationships_df(cat, CLAIMS), run.suspicions_df(cat, SUSPICIONS))
    return rels, sus, _all_verdicts(cat)


@query
def join_lines(spark, sf):
    cat = catalog(spark, sf)
    rels, _ = run.prepared(cat, run.relationships_df(cat, CLAIMS), run.suspicions_df(cat, []))
    return report.join_lines(rels, verdicts.decide(run.measure(cat, CLAIMS, [], SETTINGS), SETTINGS))


@query
def problem_lines(spark, sf):
    cat = catalog(spark, sf)
    _, sus = run.prepared(cat, run.relationships_df(cat, []), run.suspicions_df(cat, SUSPICIONS))
    return report.problem_lines(sus, verdicts.decide(run.measure(cat, [], SUSPICIONS, SETTINGS), SETTINGS))


@query
def table_reports(spark, sf):
    cat = catalog(spark, sf)
    return run.reports(cat, *_told(cat), SETTINGS)
