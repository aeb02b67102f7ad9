"""Claims before they are measured."""

from fixtures import shop
from pyspark.sql import functions as F

from plumbline import Catalog, Relation, schema
from plumbline.operators.claims import (
    claims_from_keys,
    claims_from_values,
    dedupe_relationships,
    dedupe_suspicions,
    relationship_id,
    resolve_names,
    spell_claims,
    spell_suspicions,
    suspicion_id,
)
from plumbline.sources.catalog import declared_keys

REL = schema.RELATIONSHIPS


def rel(f, fc, t, tc, when=(None, None), basis="inferred", confidence=0.5, reason="r"):
    return (f, fc, t, tc, *when, basis, confidence, reason)


def test_names_resolve_exactly_first_then_in_any_case(spark):
    df = spark.range(1)
    cat = Catalog(spark, [Relation("orders", df), Relation("Orders", df), Relation("sales.t", df, schema="sales"), Relation("plain", df)])
    asked = ["orders", "Orders", "ORDERS", " orders ", "default.orders", "sales.t", "SALES.T", "t", "DEFAULT.plain", "gone"]
    got = {r["name"]: r["resolved"] for r in resolve_names(spark.createDataFrame([(a,) for a in asked], "name string"), cat.relations_df()).collect()}
    assert got == {
        "orders": "orders", "Orders": "Orders", "ORDERS": "Orders", " orders ": "orders", "default.orders": "orders", "sales.t": "sales.t",
        "SALES.T": "sales.t", "t": None, "DEFAULT.plain": "plain", "gone": None,
    }
    assert {a: (r.name if (r := cat.find(a)) else None) for a in asked} == got


def test_ids(spark):
    claims = spark.createDataFrame([rel("a", "x", "b", "y"), rel("a", "x", "b", "y", ("c", "v"))], REL)
    assert [r[0] for r in claims.select(relationship_id()).collect()] == ["relationship:a.x->b.y", "relationship:a.x->b.y[c=v]"]
    sus = spark.createDataFrame([("dead_table", ["a"], None, ""), ("inconsistent_values", ["a", "b"], "c", "")], schema.SUSPICIONS)
    assert [r[0] for r in sus.select(suspicion_id()).collect()] == ["suspicion:dead_table:a", "suspicion:inconsistent_values:a+b.c"]


def test_one_row_per_claim_whatever_the_order(spark):
    copies = [
        rel("ORDERS", "x", "customers", "y", reason="z", confidence=0.9),
        rel("orders", "x", "Customers", "y", basis="stated", reason="m"),
        rel("orders", "x", "customers", "y", basis="stated", reason="a"),
        rel("orders", "x", "customers", "y", ("k", "v")),
    ]
    relations = shop(spark).relations_df()
    for rows in (copies, copies[::-1]):
        got = dedupe_relationships(spell_claims(spark.createDataFrame(rows, REL), relations)).orderBy("claim_id").collect()
        assert [(r["claim_id"], r["basis"], r["reason"]) for r in got] == [
            ("relationship:orders.x->customers.y", "stated", "a"),
            ("relationship:orders.x->customers.y[k=v]", "inferred", "r"),
        ]
    sus = [("dead_table", ["CARS"], None, "b"), ("dead_table", ["cars"], None, "a"), ("dead_table", ["cars"], None, "a"), ("other", ["b", "cars", "a"], "", "x")]
    got = dedupe_suspicions(spell_suspicions(spark.createDataFrame(sus, schema.SUSPICIONS), relations)).orderBy("claim_id").collect()
    assert [(r["claim_id"], r["tables"], r["detail"]) for r in got] == [
        ("suspicion:dead_table:cars", ["cars"], "a; b"),
        ("suspicion:other:b+cars+a", ["b", "cars", "a"], "x"),
    ]


def test_very_many_copies_of_one_claim_merge(spark):
    many = spark.range(40_000).selectExpr("'dead_table' AS kind", "array('cars') AS tables", "cast(null AS string) AS column", "concat('d', id % 3) AS detail")
    assert [r["detail"] for r in dedupe_suspicions(many).collect()] == ["d0; d1; d2"]


def test_claims_from_keys_and_values(spark):
    cat = shop(spark)
    got = claims_from_keys(cat.keys_df()).orderBy("from_column").collect()
    assert [(r["from_table"], r["from_column"], r["to_table"], r["to_column"], r["basis"]) for r in got] == [
        ("vehicles", "customer_id", "customers", "id", "stated"),
        ("order_items", "order_id", "orders", "id", "stated"),
        ("order_items", "product_id", "products", "id", "stated"),
    ]
    lists = spark.createDataFrame([("t", "kind", ["a", "b"]), ("u", "kind", ["c"])], "table string, column string, values array<string>")
    branches = claims_from_values(lists, "t", "ref", "posts", "id").orderBy("when_equals")
    assert [(r["when_column"], r["when_equals"]) for r in branches.collect()] == [("kind", "a"), ("kind", "b")]
    assert branches.schema.names == schema.RELATIONSHIPS.names
    keys = {r["table"]: (r["primary_key"], r["foreign_keys"]) for r in declared_keys(cat.keys_df()).collect()}
    assert keys["events"] == ("id, happened_on", 0) and keys["order_items"] == ("id", 2)


def test_relations_and_columns(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 3 AS part").write.partitionBy("part").parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    cat = Catalog(spark, [Relation("p", df, partition_columns=("part",)), Relation("q", df)])
    got = {r["name"]: r["partitions"] for r in cat.relations_df().collect()}
    assert got == {"p": 3, "q": None}
    columns = {(r["table"], r["column"]): (r["ordinal"], r["type"], r["family"], r["is_integer"]) for r in cat.columns_df().collect()}
    assert columns["p", "part"] == (1, "int", "other", True)
    assert Catalog.from_parquet(spark, str(tmp_path), ["missing"])["missing"].unread.startswith("could not be read")


def test_session_tables_and_views(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS plumb LOCATION '" + str(tmp_path / "db") + "'")
    spark.range(5).write.saveAsTable("plumb.t")
    spark.sql("CREATE VIEW plumb.v AS SELECT id FROM plumb.t WHERE id > 1")
    try:
        cat = Catalog.from_tables(spark, ["plumb"])
        got = {r["name"]: (r["kind"], r["definition"]) for r in cat.relations_df().collect()}
        assert got["plumb.t"] == ("table", None)
        assert got["plumb.v"][0] == "view" and "WHERE id > 1" in got["plumb.v"][1]
        assert cat.find("PLUMB.V").df.count() == 3
    finally:
        spark.sql("DROP DATABASE plumb CASCADE")


def test_names_with_dots_and_backticks(spark):
    df = spark.range(3).select(F.col("id").alias("a.b"), F.col("id").alias("c`d"))
    cat = Catalog(spark, [Relation("odd", df)], [("odd", "p", 0, "a.b", None, None)])
    from plumbline import Settings
    from plumbline.operators.joins import Relationship, measure_relationships
    from plumbline.operators.profile import table_profile

    assert {r["column"] for r in table_profile(cat, Settings()).collect()} == {"a.b", "c`d"}
    assert measure_relationships(cat, [Relationship("odd", "c`d", "odd", "a.b")], Settings()).first()["hits"] == 3
