"""Two runs side by side, and the findings as text."""

import pytest
from fixtures import AS_OF, CANARY, QUANTITY, SHOP_JOINS, SHOP_PROBLEMS, on_disk, polymorph, shop
from pyspark.sql import functions as F

from plumbline import Catalog, Relation, Settings, schema
from plumbline.functions.rules import change_class
from plumbline.functions.text import listed, number, sql_literal
from plumbline.operators.compare import change_tally, gate, schema_fingerprint
from plumbline.operators.joins import Relationship
from plumbline.operators.problems import Suspicion
from plumbline.operators.profile import describe_table
from plumbline.operators.report import change_rows, join_lines, problem_lines
from plumbline.plans.check import CheckReport, check, notes, shows_more
from plumbline.plans.run import measure_join, prepared, relationships_df, reports, snapshot_of, suspicions_df, verify
from plumbline.sources.snapshot import invalid_settings, read_snapshot, write_snapshot, write_table_reports

SETTINGS = Settings(as_of=AS_OF)
STATUSES = schema.STATUSES
# A status that is worse than another has the higher number; the others cannot be put in order.
WORSE = {"relationship": ["confirmed", "broken", "rejected"], "suspicion": ["rejected", "confirmed"]}


def expected(kind, before, after):
    """A worse status is a regression, a fall to the best from the next one an improvement, and nothing else is either."""
    order = WORSE[kind]
    if before == after:
        return "unchanged"
    if before in order and after in order:
        if order.index(after) > order.index(before):
            return "regression"
        return "improved" if order.index(before) == 1 else "changed"
    return "not measured" if "unverifiable" in (before, after) else "changed"


def classified(spark, rows, tolerance=0.01):
    df = spark.createDataFrame(rows, "kind string, before string, after string, hb double, ha double, missing string")
    c = F.col
    cls = change_class(c("kind") == "relationship", c("before"), c("after"), c("hb"), c("ha"), c("missing"), tolerance)
    return [r[0] for r in df.coalesce(1).select(cls).collect()]


def test_every_pair_of_statuses(spark):
    cells = [(k, b, a, expected(k, b, a)) for k in WORSE for b in STATUSES for a in STATUSES]
    assert classified(spark, [(k, b, a, None, None, None) for k, b, a, _ in cells]) == [c for *_, c in cells]
    assert classified(spark, [("relationship", "confirmed", "unverifiable", None, None, "t.c")]) == ["stale"]


def test_drift(spark):
    row = ("relationship", "broken", "broken")
    assert classified(spark, [(*row, 0.81, 0.82, None), (*row, 0.82, 0.81, None), (*row, 0.8, 0.8, None), (*row, 0.8, 0.805, None)]) == ["drift", "drift", "unchanged", "unchanged"]
    assert classified(spark, [(*row, 0.8, 0.8, None), (*row, 0.8, 0.8001, None)], 0.0) == ["unchanged", "drift"]


def kept(catalog, joins=SHOP_JOINS, problems=SHOP_PROBLEMS, settings=SETTINGS):
    rels, sus = prepared(catalog, relationships_df(catalog, joins), suspicions_df(catalog, problems))
    verdicts = verify(catalog, relationships_df(catalog, joins), suspicions_df(catalog, problems), settings)
    return snapshot_of(catalog, rels, sus, verdicts, settings)


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    """A run over the shop, written and read back."""
    path = str(tmp_path_factory.mktemp("snapshot"))
    write_snapshot(kept(shop(spark)), path)
    return read_snapshot(spark, path), path


def moved(report):
    return {r["claim_id"].split(":", 1)[1]: (r["class"], r["before"], r["after"]) for r in report.changes.where("class <> 'unchanged'").collect()}


def tally(report):
    return {r["class"]: r["items"] for r in change_tally(report.changes, report.relations).collect()}


def test_an_unchanged_catalog_passes(spark, snapshot):
    report = check(shop(spark), snapshot[0], SETTINGS)
    assert tally(report) == {"unchanged": 12} and not report.schema_changed and report.settings.isEmpty()
    assert [gate(report.changes, report.relations, g).first()[0] for g in ("regression", "change", "never")] == [False] * 3


def test_what_moves_is_classified(spark, snapshot):
    cat = shop(spark)
    customers = cat["customers"].df
    missing = spark.range(1, 501).where("id % 25 < 3").selectExpr("cast(9000 + id AS int) AS id").orderBy("id")

    def with_missing(n):
        more = missing.limit(n).select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in customers.schema.fields[1:]])
        return cat.replace(customers=customers.unionByName(more))

    improved = check(with_missing(60), snapshot[0], SETTINGS)
    assert moved(improved) == {"orders.customer_id->customers.id": ("improved", "broken", "confirmed")}
    assert [gate(improved.changes, improved.relations, g).first()[0] for g in ("regression", "change", "never")] == [False, True, False]
    assert moved(check(with_missing(10), snapshot[0], SETTINGS)) == {"orders.customer_id->customers.id": ("drift", "broken", "broken")}
    shifted = cat["order_items"].df.withColumn("order_id", F.expr("if(id % 5 = 0, order_id + 1000, order_id)"))
    regressed = check(cat.replace(order_items=shifted), snapshot[0], SETTINGS)
    assert moved(regressed) == {"order_items.order_id->orders.id": ("regression", "confirmed", "broken")}
    assert gate(regressed.changes, regressed.relations).first()[0] is True
    filled = check(cat.replace(cars=cat["vehicles"].df), snapshot[0], SETTINGS)
    assert {k: v[0] for k, v in moved(filled).items()} == {
        "dead_table:cars": "improved", "cars.customer_id->customers.id": "changed", "inconsistent_values:cars.make": "changed",
    }


def test_what_is_gone_is_stale(spark, snapshot):
    cat = shop(spark)
    report = check(cat.replace(cars=None, added=spark.range(1)), snapshot[0], SETTINGS)
    assert tally(report) == {"stale": 5, "unchanged": 9} and report.schema_changed
    assert {(r["name"], r["found_in"]) for r in report.relations.collect()} == {("cars", "before"), ("added", "now")}
    lines = [(r["class"], r["name"], r["after"]) for r in change_rows(report.changes, report.relations).orderBy("position").collect()]
    assert lines[0] == ("stale", "relationship:cars.customer_id->customers.id", "cars is not in the database")
    assert lines[3:] == [("stale", "added", "in the database, not in the context"), ("stale", "cars", "in the context, not in the database")]
    dropped = check(cat.replace(orders=cat["orders"].df.drop("status")), snapshot[0], SETTINGS)
    gone = {r["claim_id"]: r["missing"] for r in dropped.changes.where("class = 'stale'").collect()}
    assert gone == {"suspicion:inconsistent_values:orders.status": "orders.status"}


def test_a_name_that_never_was_is_not_stale(spark):
    cat = shop(spark)
    invented = kept(cat, [Relationship("nothing", "a", "orders", "id")], [Suspicion("dead_table", ("nowhere",))])
    assert tally(check(cat, invented, SETTINGS)) == {"unchanged": 2}


def test_a_snapshot_is_measured_with_its_own_settings(spark):
    cat = shop(spark)
    was = kept(cat, SHOP_JOINS[:1], [], Settings(as_of=AS_OF, join_confirmed=0.85))
    report = check(cat, was, SETTINGS)
    assert tally(report) == {"unchanged": 1}
    assert [tuple(r) for r in report.settings.collect()] == [("join_confirmed", 0.85, 0.95)]


def test_wider_settings_switch_conditions_off(spark):
    cat = polymorph(spark)
    guess = Relationship("comments", "commentable_id", "posts", "id", "body", f"{CANARY} comment 1")
    was = kept(cat, [guess], [], Settings(categorical_max_distinct=1000, categorical_min_rows_per_value=1))
    assert shows_more(Settings(categorical_max_distinct=1000), Settings()) and not shows_more(Settings(), Settings())
    assert check(cat, was, Settings()).changes.first()["after"] == "unverifiable"


def test_snapshots(spark, snapshot, tmp_path):
    back, path = snapshot
    again = f"{tmp_path}/again"
    write_snapshot(kept(shop(spark), SHOP_JOINS[::-1], SHOP_PROBLEMS[::-1]), again)

    def text(p, part):
        return [r[0] for r in spark.read.text(f"{p}/{part}").collect()]

    for part in ("meta", "settings", "relations", "columns", "keys", "relationships", "suspicions", "verdicts"):
        assert text(path, part) == text(again, part), part
        assert CANARY not in str(text(path, part))
    line = next(v for v in text(path, "verdicts") if "orders.customer_id" in v)
    assert '"orphansAbove":60.0' in line and '"hit":0.88' in line
    newer = f"{tmp_path}/newer"
    write_snapshot(back, newer)
    spark.createDataFrame([(2, "x")], "format int, fingerprint string").write.mode("overwrite").json(f"{newer}/meta")
    with pytest.raises(ValueError, match="newer"):
        read_snapshot(spark, newer)
    bad = spark.createDataFrame(
        [("join_confirmed", 0.2), ("join_broken", 0.5), ("pilot_files", 1.5), ("sample_seed", 7.0), ("stale_after_days", None)], "name string, value double"
    )
    assert sorted(r["name"] for r in invalid_settings(bad).collect()) == ["join_broken", "pilot_files", "stale_after_days"]


def test_a_fingerprint_moves_with_the_schema_alone(spark):
    def of(cat):
        return schema_fingerprint(cat.relations_df(), cat.columns_df(), cat.keys_df()).first()[0]

    cat = shop(spark)
    assert of(cat) == of(cat.replace(cars=cat["vehicles"].df))
    assert of(cat) != of(cat.replace(cars=cat["cars"].df.drop("make")))
    assert of(cat) != of(Catalog(spark, cat.relations, cat.keys[1:]))


def test_findings_text(spark, tmp_path):
    cat = on_disk(shop(spark), tmp_path / "data")
    joins = [*SHOP_JOINS, QUANTITY]
    rels, sus = prepared(cat, relationships_df(cat, joins), suspicions_df(cat, SHOP_PROBLEMS))
    verdicts = verify(cat, relationships_df(cat, joins), suspicions_df(cat, SHOP_PROBLEMS), SETTINGS)
    lines = {r["claim_id"]: r["line"] for r in join_lines(rels, verdicts).collect()}
    assert lines[SHOP_JOINS[0].claim_id] == (
        "**BROKEN** orders.customer_id -> customers.id: 88.0% match (440 of 500 rows), 60 orphans, all above the highest customers.id (inferred)."
        " An inner join drops the orphans: use LEFT JOIN, or filter them on purpose."
    )
    assert lines[SHOP_JOINS[1].claim_id] == "order_items.order_id -> orders.id: confirmed, 100.0% of 1200 rows match."
    assert lines[SHOP_JOINS[3].claim_id] == "cars.customer_id -> customers.id (inferred, not measured: no non-null rows to test)"
    assert lines[QUANTITY.claim_id] == (
        "order_items.quantity -> products.id: confirmed on weak evidence, 100.0% of 1200 rows match, but the same values would also match"
        " 5 other keys, so the match alone does not prove this join (inferred)."
    )
    problems = {(r["claim_id"], r["table"]): r["line"] for r in problem_lines(sus, verdicts).collect()}
    assert problems["suspicion:inconsistent_values:orders.status", "orders"] == (
        "**inconsistent_values status**: distinctValues 5, canonicalForms 3, collisions 2. Compare with lower(btrim(status)). shipped / SHIPPED (inferred)"
    )
    assert problems["suspicion:duplicate_entity:products+products_legacy", "products_legacy"] == (
        "**duplicate_entity products**: total 80, matched 70, sharedColumns 5, overlap 0.875, totalReverse 70, matchedReverse 70, overlapReverse 1"
        " (total, matched and overlap over products; the Reverse ones over products_legacy). same columns and values (inferred)"
    )
    assert problems["suspicion:other:customers", "customers"] == (
        "other (inferred, not measured: no measurement exists for this kind of suspicion): cannot be measured"
    )
    pages = reports(cat, rels, sus, verdicts, SETTINGS)
    got = {r["table"]: r["report"] for r in pages.collect()}
    assert set(got) == {r.name for r in cat.relations}
    assert CANARY not in str(got) and "rejected" not in str(got)
    assert got["orders"].startswith("# orders\n\ntable, ~500 rows, primary key: id\n\n## Joins\n\n- ")
    assert '## Values\n\n- status: "Pending", "SHIPPED", "cancelled", "pending", "shipped"\n' in got["orders"]
    assert "table, no rows, primary key: id" in got["cars"]
    assert "materialized view, never refreshed (reading it raises an error), primary key: none" in got["order_totals"]
    write_table_reports(pages, f"{tmp_path}/reports")
    assert spark.read.text(f"{tmp_path}/reports/table=orders", wholetext=True).first()[0] == got["orders"] + "\n"


def test_orphans_in_several_places_and_nulls(spark):
    facts = spark.createDataFrame([(v,) for v in (-1, 0, 5, 5, 50, 99, None)], "k int")
    cat = Catalog(spark, [Relation("facts", facts), Relation("keys", spark.createDataFrame([(0,), (5,), (60,)], "id int"))], [("keys", "p", 0, "id", None, None)])
    line = measure_join(cat, "facts", "k", "keys", "id", Settings()).first()["line"]
    assert line == (
        "**BROKEN** facts.k -> keys.id: 50.0% match (3 of 6 rows), 3 orphans, 1 above the highest keys.id, 1 below the lowest keys.id, and 1 inside the"
        " keys.id range (inferred). An inner join drops the orphans: use LEFT JOIN, or filter them on purpose."
        " 1 rows (14.3%) have no k; an inner join drops them too."
    )
    rejected = measure_join(cat, "keys", "id", "facts", "k", Settings()).first()
    assert rejected["status"] == "broken" and rejected["orphans_above"] is None


def test_an_old_table_is_told_as_unchanged(spark):
    cat = Catalog(spark, [Relation("old", spark.sql("SELECT date'2026-01-01' AS day"))])
    sus = suspicions_df(cat, [Suspicion("dead_table", ("old",), None, "old")])
    _, named = prepared(cat, relationships_df(cat, []), sus)
    line = problem_lines(named, verify(cat, relationships_df(cat, []), sus, SETTINGS)).first()["line"]
    assert line == (
        "**dead_table**: exact 1, count 1, ageDays 181. No row is newer than 181 days: the table is unchanged, as a reference table is too;"
        " nothing here shows it unused. old (inferred)"
    )


def test_every_change_is_listed(spark):
    changes = spark.range(60).selectExpr(
        "concat('relationship:', lpad(id, 2, '0')) AS claim_id", "if(id = 59, 'regression', 'drift') AS class", "'broken' AS before", "0.6D AS hit_before",
        "'broken' AS after", "0.7D AS hit_after", "cast(null AS string) AS skipped", "cast(null AS string) AS missing",
    )
    none = spark.createDataFrame([], "name string, found_in string")
    got = change_rows(changes, none).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 61))
    assert [r["name"][-2:] for r in got] == ["59", *[f"{i:02}" for i in range(59)]] and got[0]["before"] == "broken 60.0%"


def test_notes_of_a_check(spark):
    settings = spark.createDataFrame([("join_broken", 0.5, 0.6)], "name string, before double, now double")
    told = [sorted(tuple(r) for r in notes(CheckReport(None, None, settings, changed)).collect()) for changed in (True, False)]
    assert told == [[("schema changed", None, None, None), ("setting differs", "join_broken", 0.5, 0.6)], [("setting differs", "join_broken", 0.5, 0.6)]]


def test_text_helpers(spark):
    def of(column):
        return spark.range(1).select(column).first()[0]

    assert [of(number(F.lit(v))) for v in (1.0, 0.875, 10.0, 100, 0.0001, 0.0, -2.5)] == ["1", "0.875", "10", "100", "0.0001", "0", "-2.5"]
    assert of(sql_literal(F.lit("it's"))) == "'it''s'" and of(sql_literal(F.lit("a\n\\b"))) == "E'a\\n\\\\b'"
    assert [of(listed(F.array(*[F.lit(x) for x in v]))) for v in ("a", "ab", "abc")] == ["a", "a and b", "a, b, and c"]


def test_comments_are_part_of_the_schema(spark, tmp_path):
    def catalog(note):
        df = spark.range(3).withMetadata("id", {"comment": note} if note else {})
        df.write.mode("overwrite").parquet(f"{tmp_path}/{note}/t.parquet")
        return Catalog.from_parquet(spark, f"{tmp_path}/{note}", ["t"])

    def fingerprint(cat):
        return schema_fingerprint(cat.relations_df(), cat.columns_df(), cat.keys_df()).first()[0]

    none, one, other = (catalog(n) for n in (None, "the key", "a number"))
    assert one.columns_df().first()["comment"] == "the key" and none.columns_df().first()["comment"] is None
    assert len({fingerprint(c) for c in (none, one, other)}) == 3
    told = Relation("t", spark.range(3).toDF("id"), comment="all things")
    cat = Catalog(spark, [told])
    assert cat.relations_df().first()["comment"] == "all things" and fingerprint(cat) not in (fingerprint(Catalog(spark, [Relation("t", told.df)])),)
    described = describe_table(cat, "t", Settings()).collect()
    assert "all things" not in str(described)
