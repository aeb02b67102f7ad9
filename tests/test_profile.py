"""Profiles, sampling and sizes."""

from hashlib import md5

import pytest
from fixtures import CANARY, on_disk, polymorph, rows, shop
from pyspark.sql import functions as F

from plumbline import Catalog, Relation, Settings
from plumbline.functions.rules import is_categorical
from plumbline.operators.joins import Relationship, measure_relationships
from plumbline.operators.profile import _distinct_values, _picked, describe_table, listed_columns, redacted_sample, table_profile, value_lists
from plumbline.operators.problems import inconsistent_groups
from plumbline.operators.sampling import Sample, Scan, bounded_scan, lowest, repeatable_sample, sample_cap
from plumbline.sources.sizes import partition_estimate, parts_of, pilot_row_estimate, row_counts, row_estimate, sizes

S = Settings()


@pytest.mark.parametrize(
    "non_null, distinct, longest, settings, expected",
    [
        (250, 4, 2, {}, True), (40, 40, 17, {}, False), (40, 3, 9, {}, True), (0, 0, 0, {}, False), (250, 1, 32, {}, False),
        (250, 51, 5, {}, False), (1, 1, 5, {}, False), (25, 24, 10, {}, False), (25, 13, 10, {}, False), (25, 12, 10, {}, True),
        (25, 24, 10, {"categorical_min_rows_per_value": 1}, True), (25, 5, 10, {"categorical_min_rows_per_value": 6}, False),
    ],
)
def test_categorical_rule(spark, non_null, distinct, longest, settings, expected):
    flag = is_categorical(F.lit(distinct), F.lit(non_null), F.lit(longest), Settings(**settings))
    assert spark.range(1).select(flag).first()[0] is expected


def profiled(catalog, settings=S):
    return {(r["table"], r["column"]): r.asDict() for r in table_profile(catalog, settings).collect()}


def test_shop(spark):
    cat = shop(spark)
    got = profiled(cat)
    address = got["customers", "address"]
    assert (address["rows"], address["non_null"], address["null_rate"], address["distinct"], address["visible"]) == (250, 225, 1 - 225 / 250, 225, False)
    assert got["customers", "api_token"]["distinct"] == 1 and not got["customers", "api_token"]["visible"]
    assert got["customers", "id"]["visible"] and not got["customers", "id"]["categorical"]
    assert got["vehicles", "customer_id"]["visible"] and not got["orders", "customer_id"]["visible"]
    assert (got["orders", "created_at"]["year_min"], got["orders", "created_at"]["year_max"]) == (2026, 2026)
    assert (got["events", "happened_on"]["year_min"], got["events", "happened_on"]["year_max"]) == (None, None)  # a key, so shown
    assert got["cars", "make"]["rows"] == 0 and got["cars", "make"]["null_rate"] == 0
    assert got["order_totals", "orders"]["unmeasured"] == "a materialized view that has never been refreshed cannot be read"
    described = {r["column"]: r.asDict() for r in describe_table(cat, "customers", S).collect()}
    assert described["country"]["distinct"] == 4 and described["id"]["row_estimate"] == 250 and described["id"]["primary_key"] == "id"
    assert not {"max_length", "year_min", "year_max"} & set(described["id"]) and CANARY not in str(described)
    assert len(described["country"]["values"]) == 4 and described["address"]["values"] is None


def test_value_lists_and_samples_hold_no_hidden_value(spark):
    cat = shop(spark)
    profile = table_profile(cat, S)
    lists = value_lists(cat, S, listed_columns(profile, "categorical"))
    got = {(r["table"], r["column"]): r["values"] for r in lists.collect()}
    assert got["orders", "status"] == ["Pending", "SHIPPED", "cancelled", "pending", "shipped"]
    assert got["products", "category"] == ["fluids", "parts", "tools"]
    assert CANARY not in str(got)
    visible = {c for t, c in listed_columns(profile, "visible") if t == "customers"}
    sample = redacted_sample(cat, "customers", S, visible)
    assert sample.columns == cat["customers"].struct.names
    shown = sample.collect()
    assert len(shown) == 15 and CANARY not in str(shown)
    assert {r["full_name"] for r in shown} == {"[hidden]"}
    assert shown == redacted_sample(cat.replace(customers=cat["customers"].df.repartition(7)), "customers", S, visible).collect()


def test_sample_rows_are_picked_before_a_column_is_read(spark, tmp_path):
    df = spark.range(5_000).selectExpr("id", "concat('secret ', id) AS hidden", "cast(id % 3 AS string) AS kind")
    df.repartition(40).write.parquet(f"{tmp_path}/t.parquet")
    cat = Catalog.from_parquet(spark, str(tmp_path), ["t"])
    plan = _picked(cat["t"].df, S)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_tmp_metadata_row_index:bigint>" in plan and "TakeOrderedAndProject" in plan
    sample = redacted_sample(cat, "t", S, {"id", "kind"})
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,kind:string" in plan and "hidden:string" not in plan and len(sample.inputFiles()) <= 40
    rows_shown = sample.collect()
    assert len(rows_shown) == 15 and {r["hidden"] for r in rows_shown} == {"[hidden]"} and len({r["id"] for r in rows_shown}) == 15
    assert sorted(rows_shown) == sorted(redacted_sample(cat, "t", S, {"id", "kind"}).collect())
    assert sorted(rows_shown) != sorted(redacted_sample(cat, "t", Settings(sample_seed=2), {"id", "kind"}).collect())


def test_reveal_shows_a_hidden_column(spark):
    cat = shop(spark)
    got = profiled(Catalog(spark, cat.relations, cat.keys, reveal={"customers.full_name", "default.orders.total_cents"}))
    assert got["customers", "full_name"]["visible"] and got["orders", "total_cents"]["visible"]
    assert not got["customers", "email"]["visible"]


def test_every_type_is_profiled(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (1Y, 2.50BD, true, X'00ff', array(1, 2), map('a', 1), named_struct('x', 1), interval 1 day, repeat('é', 100)),
          (1Y, 2.50BD, null, X'00fe', array(1, 3), map('a', 2), named_struct('x', 1), interval 1 day, concat(repeat('é', 99), 'e'))
        AS t(b, d, f, bin, a, m, s, i, long)""")
    lcase = spark.sql("SELECT v COLLATE UTF8_LCASE AS v, 1 AS n FROM VALUES ('x'), ('X'), ('y'), (null) AS t(v)")
    got = profiled(Catalog(spark, [Relation("t", df), Relation("c", lcase)]))
    assert {k[1]: v["distinct"] for k, v in got.items() if k[0] == "t"} == {"b": 1, "d": 1, "f": 1, "bin": 2, "a": 2, "m": 2, "s": 1, "i": 1, "long": 2}
    assert got["t", "long"]["max_length"] == 100 and got["t", "d"]["max_length"] == 4
    assert (got["c", "v"]["distinct"], got["c", "v"]["non_null"], got["c", "v"]["rows"]) == (2, 3, 4)


def test_doubles_are_told_apart_as_they_read(spark):
    df = spark.sql("SELECT cast(v AS double) AS v FROM VALUES ('0.0'), ('-0.0'), ('NaN'), ('NaN'), ('Infinity'), ('1e7'), (null), ('0.0') AS t(v)")
    cat = Catalog(spark, [Relation("t", df)])
    got = profiled(cat)["t", "v"]
    assert (got["distinct"], got["non_null"], got["rows"], got["max_length"]) == (5, 7, 8, 8)
    assert value_lists(cat, S, [("t", "v")]).first()["values"] == ["-0.0", "0.0", "1.0E7", "Infinity", "NaN"]


def test_partitioning_does_not_move_a_profile(spark):
    cat = polymorph(spark)
    moved = cat.replace(**{r.name: r.df.repartition(17) for r in cat.relations})
    assert profiled(cat) == profiled(moved)


def test_hot_and_long_values(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, repeat('h', 5000), concat(repeat('t', 70), id)) AS v", "id % 7 AS k")
    got = profiled(Catalog(spark, [Relation("t", df)]))
    assert got["t", "v"]["distinct"] == 1 + sum(1 for i in range(20_000) if i % 3)
    assert got["t", "v"]["max_length"] == 5000 and got["t", "k"]["categorical"]


def test_a_sample_is_the_same_however_the_data_lies(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "id % 5 AS v", "if(id % 2 = 0, null, 'x') AS n")
    for key in (["id"], None):
        one, other = (repeatable_sample(df.repartition(p), 0.1, 1, key).select("id") for p in (1, 17))
        assert one.exceptAll(other).isEmpty() and 1_700 < one.count() == other.count() < 2_300
    assert not repeatable_sample(df, 0.1, 1, ["id"]).exceptAll(repeatable_sample(df, 0.1, 2, ["id"])).isEmpty()
    # Of a file the row's place is its identity, so rows that are all alike are still sampled one by one.
    path = f"{tmp_path}/same.parquet"
    spark.range(20_000).selectExpr("1 AS v").repartition(4).write.parquet(path)
    n = repeatable_sample(spark.read.parquet(path), 0.1, 1).count()
    assert 1_700 < n < 2_300 and n == repeatable_sample(spark.read.parquet(path), 0.1, 1).count()
    capped = sample_cap(df, 50, 1, ["id"])
    assert capped.count() == 50 and capped.exceptAll(sample_cap(df.repartition(9), 50, 1, ["id"])).isEmpty()
    order = sorted(range(20_000), key=lambda i: md5(f"1|{i}".encode()).hexdigest()[:8])
    for most in (1, 4, 5, 50, 777):
        few, n = lowest(df, most, 1, ["id"])
        assert n == most and {r["id"] for r in few.collect()} == set(order[:most])
    few, n = lowest(df, 100, 1, ["id"], share=0.001)
    assert few.count() == n < 100 and lowest(df, 10**6, 1, ["id"])[1] == 20_000
    alike = spark.range(500).selectExpr("id % 2 AS v")
    assert lowest(alike, 300, 1, ["v"])[1] == lowest(alike, 300, 1, ["v"])[0].count() == 250
    assert lowest(alike, 200, 1, ["v"])[1] == 0


def test_long_categorical_values_are_told_as_they_are(spark):
    long = [c * 71 for c in "abc"]
    df = spark.createDataFrame([(v,) for v in long] * 3 + [(long[0].upper(),)] * 2, "v string")
    cat, s = Catalog(spark, [Relation("t", df)]), Settings(categorical_max_value_length=100)
    assert value_lists(cat, s, [("t", "v")]).first()["values"] == [long[0].upper(), *long]
    assert [tuple(r) for r in inconsistent_groups(cat, [("t", "v")], s).collect()] == [("t", "v", long[0], [long[0].upper(), long[0]])]
    assert inconsistent_groups(cat, [("t", "v")], S).count() == 0


def test_a_sample_of_a_wrong_estimate(spark):
    df = spark.range(20_000).toDF("id")
    s = Settings(sampled=True, sample_rows=100, sample_rows_shown=1, sample_oversample=3)
    for estimate in (101, 500, 1_000, 6_000, 19_999, 20_000):
        found = bounded_scan(Relation("t", df), estimate, s, ["id"])
        assert found.random and found.read == found.df.count() <= 300
    assert bounded_scan(Relation("t", df), 1_000, s, ["id"]).read == 300
    for estimate in (10**9, -1):
        found = bounded_scan(Relation("t", df), estimate, s, ["id"])
        assert not found.random and found.read == found.df.count() == 100
    told = Scan(Catalog(spark, [Relation(n, df) for n in "abcd"] + [Relation("e", df.limit(7))]), s, {"a": 20_000, "b": 10**9, "c": -1, "d": 90, "e": 10**9}).sizes_told()
    assert {tuple(r) for r in told.collect()} == {("a", 20_000, "pilot"), ("b", 10**9, "pilot"), ("c", -1, None), ("d", 20_000, "count"), ("e", 7, "count")}
    with_sizes = Scan(Catalog(spark, [Relation("t", df)]), s, {"t": 20_000})
    assert with_sizes(with_sizes.catalog["t"]) is with_sizes(with_sizes.catalog["t"])


def test_a_view_is_computed_once(spark):
    df = spark.range(1_000_000).groupBy((F.col("id") % 1000).alias("k")).agg(*[F.max(F.col("id") + i).alias(f"c{i}") for i in range(6)])
    plan = table_profile(Catalog(spark, [Relation("v", df)]), S)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1


def test_sizes_after_a_sample(spark):
    s = Settings(sample_rows=10, sample_rows_shown=1)

    def of(estimate, n, random):
        return Sample(spark.range(n), random, n).size(estimate, s)

    assert of(500, 10, True) == (500, False)
    assert of(500, 4, False) == (4, True)
    assert of(500, 10, False) == (500, False)
    assert of(5, 10, False) == (-1, False)
    assert of(None, 10, False) == (-1, False)


def test_partition_estimates(spark):
    parts = [("a", 10, 100), ("a", 20, 300), ("b", 10, 100), ("b", None, 50), ("c", None, 10), ("d", None, 0), ("d", 0, 0)]
    got = {r["table"]: (r["rows"], r["source"]) for r in partition_estimate(spark.createDataFrame(parts, "table string, rows bigint, bytes bigint")).collect()}
    assert got == {"a": (30, "partitions"), "b": (15, "partitions"), "c": (-1, None), "d": (-1, None)}


def test_a_partitioned_dataset_is_estimated_by_its_partitions(spark, tmp_path):
    df = spark.range(30_000).selectExpr("id", "repeat(md5(cast(id AS string)), 3) AS text", "cast(id % 20 AS int) AS day")
    df.repartition(2).write.partitionBy("day").parquet(f"{tmp_path}/facts.parquet")
    spark.range(100).write.parquet(f"{tmp_path}/flat.parquet")
    cat = Catalog.from_parquet(spark, str(tmp_path), ["facts", "flat"])
    few, all_ = Settings(sampled=True, pilot_files=5), Settings(sampled=True, pilot_files=20)
    parts = parts_of(cat["facts"], few).collect()
    assert len(parts) == 20 and sum(r["rows"] is not None for r in parts) == 5 and {r["rows"] for r in parts} == {1500, None}
    estimate = row_estimate(cat["facts"], few).first()
    assert estimate["source"] == "partitions" and 29_000 < estimate["rows"] < 31_000
    assert tuple(row_estimate(cat["facts"], all_).first()) == ("facts", 30_000, "partitions")
    assert sizes(cat, few)["facts"] == estimate["rows"] and 90 <= sizes(cat, few)["flat"] <= 110
    assert row_estimate(cat["flat"], few).first()["source"] == "pilot"
    assert pilot_row_estimate(cat["facts"], all_).first()["rows"] > 20_000  # files in folders are found too


def test_a_pilot_opens_a_few_files_and_samples_reach_rare_values(spark, tmp_path):
    path = f"{tmp_path}/big.parquet"
    df = spark.range(60_000).selectExpr("id", "if(id % 20 = 19, 'late', 'early') AS kind", "cast(id % 12 AS int) AS part")
    df.repartition(30).write.parquet(path)
    big = Relation("big", spark.read.parquet(path), files=path)
    s = Settings(sampled=True, sample_rows=5_000, pilot_files=6)
    estimate = pilot_row_estimate(big, s)
    assert 48_000 <= estimate.first()["rows"] <= 72_000
    assert estimate.inputFiles() and "file_path" in estimate._jdf.queryExecution().executedPlan().toString()
    sample = bounded_scan(big, 60_000, s, ["id"]).df
    assert 4_000 < sample.count() < 6_000
    assert sample.where("kind = 'late'").count() > 0
    assert bounded_scan(big, 4_000, s).df.count() == 60_000
    cat = Catalog(spark, [big, Relation("small", rows(spark, 1, 40, "i AS id"))], [("big", "p", 0, "id", None, None), ("small", "p", 0, "id", None, None)])
    claim = Relationship("big", "part", "small", "id")
    row = measure_relationships(cat, [claim], s).first()
    assert 4_000 < row["total"] < 6_000 and row["hits"] < row["total"]
    assert row["total"] == measure_relationships(cat, [claim], s).first()["total"]
    assert Scan.of(cat, s).is_sampled(cat["big"]) and not Scan.of(cat, s).is_sampled(cat["small"])


def test_counts(spark, tmp_path):
    cat = on_disk(shop(spark), tmp_path)
    got = {r["table"]: r["rows"] for r in row_counts(cat).collect()}
    assert got["orders"] == 500 and got["cars"] == 0 and "order_totals" not in got


@pytest.mark.parametrize(
    "wrong",
    [{"join_broken": 0.99}, {"sample_rows": 0}, {"join_confirmed": 1.1}, {"pilot_files": 1.5}, {"sample_rows": 5}, {"stale_after_days": float("nan")}],
)
def test_settings_out_of_range_are_refused(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


def test_integers_at_the_ends_of_their_range(spark):
    low, high = -(2**63), 2**63 - 1
    values = [low, low + 1, -1000, -64, -63, -1, 0, 1, 63, 64, 99, 100, high - 1, high, None, 0, high, low]
    df = spark.createDataFrame([(v, None if v is None else v % 100 - 50) for v in values], "wide bigint, narrow int")
    cat = Catalog(spark, [Relation("t", df)])
    got = {r["column"]: r for r in table_profile(cat, Settings(categorical_min_rows_per_value=1), values=True).collect()}
    known = [v for v in values if v is not None]
    assert (got["wide"]["rows"], got["wide"]["non_null"], got["wide"]["distinct"], got["wide"]["max_length"]) == (18, 17, 14, 20)
    assert got["wide"]["values"] == sorted(str(v) for v in set(known))
    assert got["narrow"]["values"] == sorted({str(v % 100 - 50) for v in known})
    lists = value_lists(cat, S, [("t", "wide")]).first()
    assert lists["values"] == got["wide"]["values"]


def test_close_integers_shuffle_a_record_for_each_word(spark):
    base = "/root/testdata/sf0.01"
    cat = Catalog.from_parquet(spark, base, ["lineitem"])
    groups = _distinct_values(Scan.of(cat, S), {"lineitem": [(0, "l_orderkey")]})
    keys = {r[0] for r in cat["lineitem"].df.select("l_orderkey").collect()}
    assert groups.count() == len({k // 64 for k in keys}) and groups.count() * 50 < len(keys)
    assert table_profile(cat, S, [("lineitem", "l_orderkey")]).first()["distinct"] == len(keys)


def test_values_come_from_the_groups_that_were_counted(spark):
    cat = Catalog.from_parquet(spark, "/root/testdata/sf0.001", ["orders", "customer"])
    frame = table_profile(cat, S, values=True)
    listed = {(r["table"], r["column"]): r["values"] for r in value_lists(cat, S, listed_columns(frame, "categorical")).collect()}
    assert {(r["table"], r["column"]): r["values"] for r in frame.collect() if r["values"] is not None} == listed
    frame._jdf.queryExecution().executedPlan().execute().count()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2 and "ReusedExchange" in final
    long_ones = Settings(categorical_max_value_length=100)
    texts = spark.range(300).selectExpr("repeat(concat('ä', id % 3), 40) AS t")
    long_list = table_profile(Catalog(spark, [Relation("long", texts)]), long_ones, values=True).first()
    assert long_list["values"] == [f"ä{i}" * 40 for i in range(3)]
