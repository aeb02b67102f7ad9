"""Data problems against golden numbers."""

from datetime import datetime

from fixtures import AS_OF, SHOP_JOINS, SHOP_PROBLEMS, shop

from plumbline import Catalog, Relation, Settings
from plumbline.operators.problems import Suspicion, inconsistent_groups, measure_suspicions, missing_key, same_definition
from plumbline.operators.verdicts import decide, empty_reasons, has_findings, relation_kinds, verdict_summary
from plumbline.plans.run import measure

SETTINGS = Settings(as_of=AS_OF)


def measured(catalog, suspicions, settings=SETTINGS):
    return {r["claim_id"]: r.asDict() for r in decide(measure_suspicions(catalog, suspicions, settings), settings).collect()}


def told(row):
    skip = ("claim_id", "position", "kind", "over", "skipped", "empty", "status")
    return {k: v for k, v in row.items() if v is not None and k not in skip}


def test_shop(spark):
    got = list(sorted(measured(shop(spark), SHOP_PROBLEMS).values(), key=lambda r: r["position"]))
    assert [r["status"] for r in got] == ["confirmed", "confirmed", "empty", "confirmed", "confirmed", "confirmed", "unverifiable"]
    assert told(got[0]) == {"exact": 1, "row_count": 0}
    assert told(got[1]) == {"distinct_values": 5, "canonical_forms": 3, "collisions": 2}
    assert told(got[2]) == {} and got[2]["skipped"] == "no non-null rows to test"
    assert told(got[3]) == {
        "total": 80, "matched": 70, "shared_columns": 5, "overlap": 0.875, "total_reverse": 70, "matched_reverse": 70, "overlap_reverse": 1.0,
    }
    assert got[3]["over"] == "products"
    assert told(got[4]) == {"has_primary_key": 0}
    assert told(got[5]) == {"populated": 0}
    assert got[6]["skipped"] == "no measurement exists for this kind of suspicion"


def test_dead_tables(spark):
    rows = "(timestamp'2026-06-30 12:00:00', date'2026-01-01'), (timestamp'2030-01-01 00:00:00', date'2026-06-01')"
    cat = Catalog(spark, [
        Relation("mixed", spark.sql(f"SELECT * FROM VALUES {rows} AS t(at, day)")),
        Relation("old", spark.sql("SELECT date'2026-04-02' AS day")),
        Relation("edge", spark.sql("SELECT date'2026-04-01' AS day, id FROM range(2)")),
        Relation("timeless", spark.range(3).toDF("id")),
        Relation("future", spark.sql("SELECT timestamp_ntz'2030-01-01 00:00:00' AS at")),
    ])
    got = measured(cat, [Suspicion("dead_table", (r.name,)) for r in cat.relations])

    def of(name):
        row = got[f"suspicion:dead_table:{name}"]
        return row["row_count"], row["age_days"], row["status"]

    assert of("mixed") == (2, 1, "rejected")
    assert of("old") == (1, 90, "rejected")
    assert of("edge") == (2, 91, "confirmed")
    assert of("timeless") == (3, None, "rejected")
    assert of("future") == (1, None, "rejected")


def test_the_age_does_not_hang_on_the_session_zone(spark):
    cat = Catalog(spark, [Relation("t", spark.sql("SELECT timestamp_ntz'2026-06-30 23:59:59' AS at"))])
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    try:
        got = measured(cat, [Suspicion("dead_table", ("t",))], Settings(as_of=datetime(2026, 7, 1)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got["suspicion:dead_table:t"]["age_days"] == 1


def test_inconsistent_values(spark):
    values = ["A", "a", " a ", "b", None, "C" * 100, "c" * 100, "\ta"]
    cat = Catalog(spark, [
        Relation("t", spark.createDataFrame([(v, None) for v in values], "v string, n string")),
        Relation("many", spark.range(60).selectExpr("cast(id AS string) AS v")),
        Relation("lcase", spark.sql("SELECT v COLLATE UTF8_LCASE AS v FROM VALUES ('x'), ('X'), ('y ') AS t(v)")),
    ])
    asked = [Suspicion("inconsistent_values", (t,), c) for t, c in (("t", "v"), ("t", "n"), ("many", "v"), ("t", None), ("t", "z"), ("lcase", "v"))]
    got = measured(cat, asked)
    tv = got["suspicion:inconsistent_values:t.v"]
    assert told(tv) == {"distinct_values": 7, "canonical_forms": 4, "collisions": 3}
    tn = got["suspicion:inconsistent_values:t.n"]
    assert (tn["status"], told(tn)) == ("empty", {"distinct_values": 0, "canonical_forms": 0, "collisions": 0})
    many = got["suspicion:inconsistent_values:many.v"]
    assert (many["status"], many["skipped"], many["distinct_values"]) == ("unverifiable", "not categorical: 60 distinct values", 60)
    assert got["suspicion:inconsistent_values:t"]["skipped"] == "no column named"
    assert got["suspicion:inconsistent_values:t.z"]["skipped"] == "unknown column t.z"
    assert told(got["suspicion:inconsistent_values:lcase.v"]) == {"distinct_values": 2, "canonical_forms": 2, "collisions": 0}
    groups = inconsistent_groups(shop(spark), [("orders", "status"), ("customers", "country")], SETTINGS)
    assert sorted((r["column"], r["canonical"], r["spellings"]) for r in groups.collect()) == [
        ("status", "pending", ["Pending", "pending"]),
        ("status", "shipped", ["SHIPPED", "shipped"]),
    ]


def test_duplicates(spark):
    long = "repeat('z', 80)"
    a = spark.range(10).selectExpr("id", f"if(id = 0, null, concat({long}, id)) AS v", "map('k', id) AS m", "1 AS only_a").unionAll(
        spark.range(10).selectExpr("id", f"if(id = 0, null, concat({long}, id))", "map('k', id)", "2")
    )
    b = spark.range(5, 20).selectExpr(f"concat({long}, id) AS v", "cast(id AS int) AS id", "map('k', id) AS m").unionAll(
        spark.sql("SELECT cast(null AS string), 0, map('k', 0L)")
    )
    texts = spark.range(5).selectExpr("cast(id AS string) AS id", "id AS only_texts")
    views = [Relation("v1", a, kind="view", definition="q"), Relation("v2", a, kind="view", definition="q"), Relation("v3", None, kind="materialized view", definition="r", columns=a.schema)]
    cat = Catalog(spark, [Relation("a", a), Relation("b", b), Relation("texts", texts), Relation("none", a.where("false")), Relation("other", spark.range(1).toDF("x")), *views])
    pairs = [("a", "b"), ("b", "a"), ("a", "texts"), ("a", "none"), ("none", "a"), ("a", "other"), ("v1", "v2"), ("v1", "v3"), ("a", "v3"), ("a",)]
    got = measured(cat, [Suspicion("duplicate_entity", p) for p in pairs])

    def of(*p):
        return got[f"suspicion:duplicate_entity:{'+'.join(p)}"]

    ab = of("a", "b")
    assert (ab["total"], ab["matched"], ab["total_reverse"], ab["matched_reverse"], ab["shared_columns"]) == (10, 6, 16, 6, 3)
    assert (ab["status"], of("b", "a")["overlap"], of("b", "a")["over"]) == ("rejected", 6 / 16, "b")
    assert (of("a", "texts")["matched"], of("a", "texts")["overlap_reverse"], of("a", "texts")["status"]) == (5, 1.0, "confirmed")
    assert (of("a", "none")["status"], of("a", "none")["skipped"]) == ("empty", "no rows to match against")
    assert (of("none", "a")["status"], of("none", "a")["skipped"], of("none", "a")["total"]) == ("empty", "no non-null rows to test", None)
    assert of("a", "other")["skipped"] == "no shared column names"
    assert (of("v1", "v2")["same_definition"], of("v1", "v2")["status"]) == (1, "confirmed")
    assert (of("v1", "v3")["same_definition"], of("v1", "v3")["status"]) == (0, "rejected")
    assert of("a", "v3")["status"] == "empty"
    assert of("a")["skipped"] == "needs two known tables, got a"
    assert [tuple(r) for r in same_definition(cat.relations_df()).collect()] == [("v1", "v2")]


def test_keys_and_summaries(spark):
    cat = shop(spark)
    assert sorted(r["name"] for r in missing_key(cat).collect()) == ["audit_log", "order_totals", "shipped_orders"]
    verdicts = decide(measure(cat, SHOP_JOINS, SHOP_PROBLEMS, SETTINGS), SETTINGS)
    summary = {(r["type"], r["status"]): r["claims"] for r in verdict_summary(verdicts).collect()}
    assert summary == {
        ("relationship", "confirmed"): 1, ("relationship", "broken"): 1, ("relationship", "rejected"): 2, ("relationship", "empty"): 1,
        ("suspicion", "confirmed"): 5, ("suspicion", "empty"): 1, ("suspicion", "unverifiable"): 1,
    }
    assert [tuple(r) for r in empty_reasons(verdicts).collect()] == [(1, "no non-null rows to test", 2)]
    assert has_findings(verdicts).first()[0] is True
    assert has_findings(verdicts.where("status = 'rejected'")).first()[0] is False
    kinds = {r["kind"]: r["relations"] for r in relation_kinds(cat.relations_df()).collect()}
    assert kinds == {"table": 9, "view": 1, "materialized view": 1}


def test_all_reasons_are_told(spark):
    rows = [("empty", r) for r, n in (("a", 4), ("b", 3), ("c", 2), ("d", 1), ("e", 1), (None, 1)) for _ in range(n)]
    verdicts = spark.createDataFrame([*rows, ("confirmed", None)], "status string, skipped string")
    assert [tuple(r) for r in empty_reasons(verdicts).orderBy("rank").collect()] == [(1, "a", 4), (2, "b", 3), (3, "c", 2), (4, "d", 1), (5, "e", 1), (6, "no reason given", 1)]
