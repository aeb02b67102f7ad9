"""Many relations and many claims, and the code path that runs outside the tests."""

import time

import pytest

from plumbline import Catalog, Relation, Settings
from plumbline.operators.compare import schema_fingerprint
from plumbline.operators.joins import Relationship, measure_relationships
from plumbline.sources.small import small_table
from suite.oracles import ORACLES
from suite.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_three_hundred_joins(spark):
    target = small_table(spark, [(i,) for i in range(50)], "id bigint")
    facts = [Relation(f"t{i:03}", small_table(spark, [(v % (40 + i % 20),) for v in range(60)], "k bigint")) for i in range(300)]
    cat = Catalog(spark, [*facts, Relation("target", target)], [("target", "p", 0, "id", None, None)])
    claims = [Relationship(r.name, "k", "target", "id", basis="stated") for r in facts]
    start = time.time()
    rows = measure_relationships(cat, claims, Settings()).collect()
    assert time.time() - start < 30
    for i, r in enumerate(rows):
        hits = sum(1 for v in range(60) if v % (40 + i % 20) < 50)
        assert (r["claim_id"], r["total"], r["hits"], r["orphans_above"]) == (claims[i].claim_id, 60, hits, 60 - hits)


def test_partitions_are_found_and_leave_the_fingerprint_alone(spark, tmp_path):
    def fingerprint(rows):
        path = f"{tmp_path}/{rows}"
        spark.range(rows).selectExpr("id", "id % 7 AS day", "'x' AS `a b`").write.partitionBy("day", "a b").parquet(f"{path}/facts.parquet")
        cat = Catalog.from_parquet(spark, path, ["facts"], reveal=["facts.id", "facts.ID"])
        assert cat["facts"].partition_columns == ("day", "a b") and cat.unknown_reveals() == ["facts.ID"]
        return cat.relations_df().first()["partitions"], schema_fingerprint(cat.relations_df(), cat.columns_df(), cat.keys_df()).first()[0]

    (few, one), (many, other) = fingerprint(3), fingerprint(30)
    assert (few, many) == (3, 7) and one == other


@pytest.mark.parametrize("name", ["measure_claims_all", "profile_all", "inconsistent_groups"])
def test_generated_code_gives_the_rows_of_the_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        frame = QUERIES[name](spark, SF)
        got = sorted((tuple(r) for r in frame.select(sorted(frame.columns)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)
    result = con.execute(ORACLES[name])
    order = sorted(range(len(result.description)), key=lambda i: result.description[i][0])
    assert got == sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)


