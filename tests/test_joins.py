"""Joins against golden numbers, in every way a join can be run."""

import pytest
from fixtures import QUANTITY, SHOP_JOINS, polymorph, shop
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import Catalog, Relation, Settings
from plumbline.operators import joins
from plumbline.operators.joins import Relationship, dense_keys, measure_relationships, orphan_rows
from plumbline.operators.verdicts import decide
from plumbline.sources import sizes

WAYS = {"by size": None, "broadcast": False, "spread": True}


@pytest.fixture(params=WAYS)
def measured(request, spark):
    """Verdicts by claim id, with the way of joining forced."""

    def run(catalog, claims, settings=None, **kw):
        s = settings or Settings()
        frame = measure_relationships(catalog, claims, s, spread=WAYS[request.param], **kw)
        return {r["claim_id"]: r.asDict() for r in decide(frame, s).collect()}

    return run


def numbers(row, *names):
    return [row[n] for n in names]


def test_shop(spark, measured):
    got = measured(shop(spark), [*SHOP_JOINS, QUANTITY])
    broken = got[SHOP_JOINS[0].claim_id]
    assert numbers(broken, "status", "total", "hits", "orphans", "nulls", "orphans_above", "orphans_below") == ["broken", 500, 440, 60, 0, 60, 0]
    assert broken["hit"] == 0.88
    assert got[SHOP_JOINS[1].claim_id]["status"] == "confirmed"
    assert got[SHOP_JOINS[1].claim_id]["candidates"] is None
    assert got[SHOP_JOINS[2].claim_id]["status"] == "rejected"
    empty = got[SHOP_JOINS[3].claim_id]
    assert numbers(empty, "status", "skipped", "empty", "total", "nulls", "hit") == ["empty", "no non-null rows to test", True, None, None, None]
    address = got[SHOP_JOINS[4].claim_id]
    assert numbers(address, "status", "total", "nulls", "orphans", "orphans_above") == ["rejected", 225, 25, 225, None]
    quantity = got[QUANTITY.claim_id]
    assert numbers(quantity, "status", "total", "hits", "candidates", "also_fits") == ["confirmed", 1200, 1200, 5, 5]


def test_polymorph(spark, measured):
    post = Relationship("comments", "commentable_id", "posts", "id", "commentable_type", "post")
    photo = Relationship("comments", "commentable_id", "photos", "id", "commentable_type", "photo")
    plain = Relationship("comments", "commentable_id", "posts", "id")
    none = Relationship("comments", "commentable_id", "posts", "id", "commentable_type", "video")
    hidden = Relationship("comments", "commentable_id", "posts", "id", "body", "guess")
    invoices = Relationship("invoices", "account_id", "accounts", "id")
    refunds = Relationship("refunds", "account_id", "accounts", "id")
    got = measured(polymorph(spark), [post, photo, plain, none, hidden, invoices, refunds])

    def of(r):
        return numbers(got[r.claim_id], "total", "hits", "orphans", "orphans_above", "orphans_below", "status")

    assert of(post) == [300, 300, 0, 0, 0, "confirmed"]
    assert of(photo) == [180, 120, 60, 60, 0, "broken"]
    assert of(plain) == [480, 480, 0, 0, 0, "confirmed"]
    assert numbers(got[none.claim_id], "status", "total", "nulls", "hits") == ["empty", 0, 0, None]
    assert numbers(got[hidden.claim_id], "status", "total") == ["unverifiable", None]
    assert got[hidden.claim_id]["skipped"] == "comments.body is not categorical, so no condition on it is measured"
    assert of(invoices) == [200, 160, 40, 0, 0, "broken"]
    assert of(refunds) == [20, 15, 5, 0, 5, "broken"]
    # Dense: comments, invoices, photos and posts; accounts is sparse. A branch is weighed on its own rows.
    assert numbers(got[post.claim_id], "candidates", "also_fits") == [3, 2]
    assert numbers(got[plain.claim_id], "candidates", "also_fits") == [3, 2]


def test_conditions_off(spark, measured):
    post = Relationship("comments", "commentable_id", "posts", "id", "commentable_type", "post")
    got = measured(polymorph(spark), [post], conditions=False)[post.claim_id]
    assert numbers(got, "status", "total") == ["unverifiable", None]


def test_names(spark, measured):
    cat = shop(spark)
    claims = [
        Relationship("nothing", "a", "orders", "id"),
        Relationship("orders", "a", "customers", "id"),
        Relationship("orders", "id", "customers", "b"),
        Relationship("cars", "b", "customers", "id"),
        Relationship("order_totals", "orders", "customers", "id"),
        Relationship(" DEFAULT.Orders ", "customer_id", "customers", "id"),
        Relationship("orders", "id", "cars", "id"),
    ]
    got = measured(cat, claims)
    rows = list(got.values())
    reasons = [r["skipped"] for r in sorted(rows, key=lambda r: r["position"])]
    assert reasons[:4] == ["unknown table nothing", "unknown column orders.a", "unknown column customers.b", "unknown column cars.b"]
    assert reasons[4] == "a materialized view that has never been refreshed cannot be read"
    assert reasons[6] == "no rows to match against"
    assert got["relationship:orders.customer_id->customers.id"]["hits"] == 440
    assert [r["status"] for r in sorted(rows, key=lambda r: r["position"])] == ["unverifiable"] * 4 + ["empty", "broken", "empty"]


def _edges(spark):
    cat = shop(spark)
    big = 2**53
    ints = {
        "fresh": spark.range(1, 1001).selectExpr("cast(id AS int) AS id"),
        "ledger": spark.range(-10, 10).selectExpr("cast(id AS int) AS id"),
        "sparse": spark.range(1, 1001, 10).selectExpr("cast(id AS int) AS id"),
        "gone": spark.range(0).selectExpr("cast(id AS int) AS id"),
        "wide": spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "id bigint"),
        "serials": spark.range(10).selectExpr(f"id + {big} AS id"),
        "serial_refs": spark.range(1, 11).selectExpr(f"id + {big} AS id", f"{big} + id % 10 AS serial_id"),
    }
    keys = [*cat.keys, *[(t, "p", 0, "id", None, None) for t in ints]]
    return Catalog(spark, [*cat.relations, *[Relation(n, d) for n, d in ints.items()]], keys)


SERIAL = Relationship("serial_refs", "serial_id", "serials", "id")


@pytest.mark.parametrize(
    "settings, quantity, serial",
    [
        ({}, [9, 7], [9, 0]),
        ({"dense_key_share": 0}, [11, 9], [11, 1]),
        # customers, fresh and ledger: gone holds no rows, so it is not one of the three.
        ({"weak_evidence_max_candidates": 3}, [3, 3], [3, 0]),
        ({"weak_evidence_max_candidates": 0}, [None, None], [None, None]),
    ],
)
def test_weighing_at_the_integer_limits(spark, measured, settings, quantity, serial):
    got = measured(_edges(spark), [QUANTITY, SERIAL], Settings(**settings))
    assert numbers(got[QUANTITY.claim_id], "candidates", "also_fits") == quantity
    assert numbers(got[SERIAL.claim_id], "candidates", "also_fits") == serial
    assert got[SERIAL.claim_id]["hit"] == 1


def test_dense_keys(spark):
    tables = [r["table"] for r in dense_keys(_edges(spark), Settings()).orderBy("position").collect()]
    assert tables == ["customers", "fresh", "ledger", "order_items", "orders", "products", "products_legacy", "serial_refs", "serials", "vehicles"]


def test_types_that_do_not_compare_are_compared_as_text(spark, measured):
    a = spark.range(10).selectExpr("id AS n", "cast(id AS string) AS s", "cast(id AS double) AS d", "cast(id AS decimal(10, 2)) AS m", "date_add(date'2020-01-01', cast(id AS int)) AS day")
    b = spark.range(5, 15).selectExpr("id AS n", "cast(id AS string) AS s", "cast(id AS double) AS d", "cast(date_add(date'2020-01-01', cast(id AS int)) AS timestamp) AS at", "repeat(concat('x', id), 50) AS long_text")
    c = spark.range(8, 10).selectExpr("repeat(concat('x', id), 50) AS long_text")
    cat = Catalog(spark, [Relation("a", a), Relation("b", b), Relation("c", c)], [("b", "p", 0, "n", None, None)])
    claims = [Relationship("a", x, "b", y) for x, y in (("n", "s"), ("s", "n"), ("n", "d"), ("m", "n"), ("d", "n"), ("day", "at"))]
    claims.append(Relationship("c", "long_text", "b", "long_text"))
    got = measured(cat, claims)
    assert [got[c.claim_id]["hits"] for c in claims] == [5, 5, 5, 5, 5, 5, 2]
    assert all(got[c.claim_id]["orphans_above"] is None for c in claims)


def test_orphans_and_a_hot_key(spark, measured, monkeypatch):
    """A third of the rows hold one value, another third are null; both ways of partitioning give the same numbers."""
    facts = spark.range(30_000).selectExpr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN null ELSE id END AS k", "id AS payload")
    keys = spark.range(0, 20_000, 2).selectExpr("id")
    for parts in (1, 17):
        cat = Catalog(spark, [Relation("facts", facts.repartition(parts)), Relation("keys", keys)], [("keys", "p", 0, "id", None, None)])
        claim = Relationship("facts", "k", "keys", "id")
        row = measured(cat, [claim])[claim.claim_id]
        values = [i for i in range(30_000) if i % 3 == 2]
        hits = sum(1 for v in values if v < 20_000 and v % 2 == 0)
        above = sum(1 for v in values if v > 19_998)
        assert numbers(row, "total", "nulls", "hits", "orphans_above", "orphans_below") == [20_000, 10_000, hits, above, 0]
        wanted = sorted((7 if i % 3 == 0 else i, i) for i in range(30_000) if i % 3 == 0 or (i % 3 == 2 and not (i < 20_000 and i % 2 == 0)))
        assert len(wanted) == 20_000 - hits
        for few in (0, joins.FEW_ORPHANS):
            monkeypatch.setattr(joins, "FEW_ORPHANS", few)
            for spread in WAYS.values():
                orphans = orphan_rows(cat, claim, spread)
                assert orphans.columns == ["k", "payload"]
                assert sorted(map(tuple, orphans.collect())) == wanted


def test_hot_rows_are_returned_or_dropped_without_one_task_holding_them(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ORPHANS", 0)
    facts = spark.range(20_000).selectExpr("CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE id END AS k", "id AS payload")
    cat = Catalog(spark, [Relation("facts", facts), Relation("keys", spark.range(0, 20_000, 2).toDF("id"))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orphans = orphan_rows(cat, Relationship("facts", "k", "keys", "id"))
        by_task = [r["n"] for r in orphans.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wanted = sum(1 for i in range(20_000) if i % 3 == 0 or (i % 3 == 2 and i % 2))
    assert sum(by_task) == wanted and len(by_task) == 8 and max(by_task) < wanted / 6


def test_branches(spark):
    cat = polymorph(spark)
    got = {r["branch"]: r.asDict() for r in joins.join_hit_rate_by_branch(cat, Relationship("comments", "commentable_id", "photos", "id"), "commentable_type").collect()}
    assert got["photo"]["hits"] == 120 and got["photo"]["total"] == 180
    assert got["post"]["total"] == 300 and got["post"]["hits"] == sum(1 for i in range(1, 301) if 1 + i % 100 <= 40)


def test_a_target_for_each_branch(spark):
    cat = polymorph(spark)
    claim = Relationship("comments", "commentable_id", "posts", "id")
    targets = {"post": ("posts", "id"), "photo": ("photos", "id"), "song": ("photos", "id")}
    got = {r["branch"]: r.asDict() for r in joins.join_hit_rate_by_branch(cat, claim, "commentable_type", targets=targets).collect()}
    assert got.keys() == {"post", "photo"}
    assert numbers(got["post"], "to_table", "total", "hits", "orphans_above", "orphans_below") == ["posts", 300, 300, 0, 0]
    assert numbers(got["photo"], "to_table", "total", "hits", "orphans_above", "orphans_below") == ["photos", 180, 120, 60, 0]
    as_text = joins.join_hit_rate_by_branch(cat, claim, "commentable_type", targets={"post": ("posts", "id"), "photo": ("comments", "body")})
    assert {r["branch"]: r["hits"] for r in as_text.collect()} == {"post": 300, "photo": 0}


def test_a_hidden_discriminator_tells_nothing(spark):
    cat = shop(spark)
    assert joins.join_hit_rate_by_branch(cat, Relationship("orders", "customer_id", "customers", "id"), "id").count() == 0
    assert joins.join_hit_rate_by_branch(cat, Relationship("vehicles", "customer_id", "customers", "id"), "customer_id").count() == 0


def test_what_may_grow_is_not_broadcast(spark):
    """Neither what no file counts, as a view, nor what a small file holds many of: delta-encoded, 20 million keys are some 100 KB."""
    few = spark.createDataFrame([(i,) for i in range(10)], "i long")
    views = {"grown": few.selectExpr("explode(sequence(i, i + 1000000)) AS id"), "counted": few.groupBy("i").count()}
    cat = Catalog(spark, [Relation(n, d) for n, d in views.items()])
    assert joins.broadcast_targets(cat, {("grown", "id"): T.LongType(), ("counted", "i"): T.LongType()}) == set()


def test_a_small_file_of_many_keys_is_not_broadcast(spark, tmp_path):
    writer = spark.range(20_000_000).selectExpr("id", "id * 1000 AS far", "cast(id AS double) AS number").coalesce(1).write
    writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/keys.parquet")
    spark.range(10).write.parquet(f"{tmp_path}/facts.parquet")
    cat = Catalog.from_parquet(spark, str(tmp_path), ["keys", "facts"])
    assert cat["keys"].df.select("id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 400_000_000
    for column in ("id", "far", "number"):
        common = joins.comparison(cat, Relationship("facts", "id", "keys", column))
        assert joins.broadcast_targets(cat, {("keys", column): common}) == set()
        plan = joins.join_hit_rate(cat, Relationship("facts", "id", "keys", column))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=broadcast") == 1  # of the claims alone
    assert joins.broadcast_targets(cat, {("facts", "id"): T.LongType(), ("keys", "id"): T.LongType()}) == {("facts", "id")}


def test_close_integers_are_a_row_for_each_word_of_them(spark):
    base = "/root/testdata/sf0.01"
    cat = Catalog.from_parquet(spark, base, ["lineitem", "orders"], [("orders", "p", 0, "o_orderkey", None, None)])
    claim = Relationship("lineitem", "l_orderkey", "orders", "o_orderkey")
    frame = joins.join_hit_rate(cat, claim)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "Exchange hashpartitioning(slot" in plan
    words = joins._keys_of(cat, T.LongType(), {("orders", "o_orderkey"): 0}).count()
    keys = {r[0] for r in cat["orders"].df.select("o_orderkey").collect()}
    assert words == len({k // 64 for k in keys}) and words * 60 < len(keys)
    for spread in WAYS.values():
        row = joins._counts(joins.Scan.of(cat, Settings()), [(0, claim)], spread).first()
        lines = [r[0] for r in cat["lineitem"].df.select("l_orderkey").collect()]
        assert (row["total"], row["hits"]) == (len(lines), sum(k in keys for k in lines))


def test_more_targets_than_one_look_up_takes(spark, monkeypatch):
    low = -(2**63)
    facts = spark.createDataFrame([(low,), (low + 70,), (-1,), (5,), (2**63 - 1,), (None,)], "k bigint")
    targets = [Relation(f"t{i}", spark.createDataFrame([(v,) for v in (low + i, 5 - i, 2**63 - 1 - i)], "id bigint")) for i in range(7)]
    cat = Catalog(spark, [Relation("facts", facts), *targets], [(r.name, "p", 0, "id", None, None) for r in targets])
    claims = [Relationship("facts", "k", r.name, "id", basis="stated") for r in targets]
    monkeypatch.setattr(joins, "TARGETS", 4)
    want = [len({low, low + 70, -1, 5, 2**63 - 1} & {low + i, 5 - i, 2**63 - 1 - i}) for i in range(7)]
    for spread in (False, True):
        assert [r["hits"] or 0 for r in measure_relationships(cat, claims, Settings(), spread=spread).orderBy("position").collect()] == want


def test_extents_come_from_footers(spark, tmp_path):
    spark.range(-5, 1000).selectExpr("id", "cast(null AS int) AS nothing", "id % 3 AS day").write.partitionBy("day").parquet(f"{tmp_path}/facts.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/none.parquet")
    cat = Catalog.from_parquet(spark, str(tmp_path), ["facts", "none"], [("facts", "p", 0, "id", None, None), ("none", "p", 0, "id", None, None)])
    frame = sizes.extent_rows([(cat["facts"], ["id"]), (cat["none"], ["id"])], footers=True)
    assert frame._jdf.queryExecution().executedPlan().toString().count("PushedAggregation: [COUNT(*), MIN(id), MAX(id)]") == 2
    found = sizes.extents(cat, {"facts": ["id", "nothing", "day"], "none": ["id"]})
    assert found["facts"] == sizes.Extent(1005, {"day": (-2, 2), "id": (-5, 999), "nothing": (None, None)})
    assert found["none"] == sizes.Extent(0, {"id": (None, None)})
    assert [tuple(r) for r in dense_keys(cat, Settings()).collect()] == [(0, "facts", "id", 1005, -5, 999)]
    claim = Relationship("none", "id", "facts", "id")
    assert joins._ends(cat, [(0, claim)]) == {("facts", "id"): (-5, 999)}  # known by now


def test_only_a_join_that_may_be_a_coincidence_reads_other_keys(spark):
    cat = Catalog.from_parquet(spark, "/root/testdata/sf0.001", ["part", "customer", "nation", "orders"], [(t, "p", 0, c, None, None) for t, c in (("part", "p_partkey"), ("customer", "c_custkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey"))])
    frame = measure_relationships(cat, [Relationship("part", "p_partkey", "customer", "c_custkey")], Settings())
    assert {f.rsplit("/", 1)[-1] for f in frame.inputFiles()} <= {"part.parquet", "customer.parquet"}


def test_conditions_of_all_claims_of_a_scan_reach_it(spark):
    cat = Catalog.from_parquet(spark, "/root/testdata/sf0.001", ["events", "supplier"], [("supplier", "p", 0, "s_suppkey", None, None)])
    plan = joins.join_hit_rate(cat, Relationship("events", "user_id", "supplier", "s_suppkey", "event_type", "click"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan


def test_claims_of_one_kind_are_one_join_over_one_read_of_each_table(spark):
    base, tables = "/root/testdata/sf0.001", ["lineitem", "orders", "part", "customer", "nation"]
    cat = Catalog.from_parquet(spark, base, tables, [("orders", "p", 0, "o_orderkey", None, None)])
    claims = [Relationship("lineitem", a, b, c) for a in ("l_orderkey", "l_partkey") for b, c in (("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"))]
    claims.append(Relationship("customer", "c_nationkey", "nation", "n_nationkey"))
    for spread in (False, True):
        plan = joins._counts(joins.Scan.of(cat, Settings()), list(enumerate(claims)), spread)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 6 and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert plan.count("Join") == (2 if spread else 1)  # one look-up; spread, the sources meet the claims too
        assert spread or "SortMergeJoin" not in plan


def test_few_orphan_rows_cross_no_shuffle(spark):
    """Against a large target only keys do; the rows are read where they lie."""
    base = "/root/testdata/sf0.001"
    cat = Catalog.from_parquet(spark, base, ["part", "customer"])
    plan = orphan_rows(cat, Relationship("part", "p_partkey", "customer", "c_custkey"), spread=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    kept = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert kept and all("row" not in line and "p_name" not in line for line in kept)
    names = spark.range(20).selectExpr("id AS key", "id AS target", "id AS `to`", "id AS `word`", "id AS `a.b`", "id AS `row`")
    odd = Catalog(spark, [Relation("odd", names), Relation("few", spark.range(15))])
    for spread in WAYS.values():
        got = orphan_rows(odd, Relationship("odd", "a.b", "few", "id"), spread)
        assert got.columns == names.columns and sorted(r["row"] for r in got.collect()) == [15, 16, 17, 18, 19]


def test_a_probed_claim_reads_only_its_columns(spark):
    base = "/root/testdata/sf0.001"
    cat = Catalog.from_parquet(spark, base, ["lineitem", "nation"], [("nation", "p", 0, "n_nationkey", None, None)])
    frame = joins.join_hit_rate(cat, Relationship("lineitem", "l_linenumber", "nation", "n_nationkey", "l_returnflag", "R"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_linenumber:int,l_returnflag:string>" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert frame.first()["total"] == spark.read.parquet(f"{base}/lineitem.parquet").where(F.col("l_returnflag") == "R").count()


def test_an_empty_source_is_told_before_a_target_that_was_never_filled(spark, measured):
    cat = shop(spark)
    claims = [Relationship("cars", "id", "order_totals", "orders"), Relationship("orders", "id", "order_totals", "orders")]
    got = measured(cat, claims)
    assert [got[c.claim_id]["skipped"] for c in claims] == [
        "no non-null rows to test",
        "a materialized view that has never been refreshed cannot be read",
    ]
