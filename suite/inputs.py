"""What is asked of the test tables: their declared keys, claims and suspicions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline import Catalog, Relation, Settings
from plumbline.operators.joins import Relationship
from plumbline.operators.problems import Suspicion

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

PRIMARY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
KEYS = [(t, "p", i, c, None, None) for t, columns in PRIMARY.items() for i, c in enumerate(columns)] + [
    (t, "f", 0, c, rt, rc) for t, c, rt, rc in FOREIGN
]
# Relations derived from the tables: a copy of a part of one, and one no row is in.
DERIVED = {"returned": "SELECT * FROM lineitem WHERE l_returnflag = 'R'", "archived": "SELECT * FROM lineitem WHERE l_quantity < 0"}

AS_OF = datetime(2002, 1, 1)
SETTINGS = Settings(as_of=AS_OF)

R = Relationship
ORDERS_CUSTOMER = R("orders", "o_custkey", "customer", "c_custkey", basis="stated", confidence=1.0)
PART_CUSTOMER = R("part", "p_partkey", "customer", "c_custkey", confidence=0.6)
CUSTOMER_SUPPLIER = R("customer", "c_custkey", "supplier", "s_suppkey", confidence=0.3)
EVENTS_SUPPLIER = R("events", "user_id", "supplier", "s_suppkey", confidence=0.5)
LINES_ORDERS = R("lineitem", "l_orderkey", "orders", "o_orderkey", basis="stated", confidence=1.0)
BRANCH_TARGETS = {"click": ("supplier", "s_suppkey"), "purchase": ("part", "p_partkey"), "signup": ("customer", "c_custkey"), "nothing": ("nation", "n_nationkey")}
CLICKS_SUPPLIER = R("events", "user_id", "supplier", "s_suppkey", "event_type", "click", confidence=0.5)
TEXT_FALLBACK = R("lineitem", "l_orderkey", "orders", "o_orderpriority", confidence=0.1)
LINENUMBER = R("lineitem", "l_linenumber", "nation", "n_nationkey", confidence=0.4)
CLAIMS = [
    ORDERS_CUSTOMER,
    LINES_ORDERS,
    R("labels", "doc_id", "documents", "doc_id", basis="stated", confidence=1.0),
    PART_CUSTOMER,
    R("lineitem", "l_partkey", "customer", "c_custkey", confidence=0.55),
    EVENTS_SUPPLIER,
    R("documents", "doc_id", "embeddings", "vec_id", confidence=0.45),
    R("documents", "doc_id", "labels", "doc_id", confidence=0.44),
    R("part", "p_size", "nation", "n_nationkey", confidence=0.2),
    CUSTOMER_SUPPLIER,
    R("pages", "page_id", "conversations", "conv_id", confidence=0.25),
    R("events", "user_id", "customer", "c_custkey", confidence=0.7),
    LINENUMBER,
    R("lineitem", "l_suppkey", "part", "p_partkey", confidence=0.35),
    CLICKS_SUPPLIER,
    R("events", "user_id", "supplier", "s_suppkey", "event_type", "refund", confidence=0.5),
    R("events", "user_id", "supplier", "s_suppkey", "props", '{"k": 1}', confidence=0.5),
    TEXT_FALLBACK,
    R("archived", "l_orderkey", "orders", "o_orderkey", confidence=0.5),
    R("orders", "o_orderkey", "archived", "l_orderkey", confidence=0.5),
    R("invoices", "id", "orders", "o_orderkey", confidence=0.5),
    R("orders", "o_parent", "orders", "o_orderkey", confidence=0.5),
]
SUSPICIONS = [
    Suspicion("dead_table", ("orders",), None, "old orders"),
    Suspicion("dead_table", ("lineitem",), None, "old lines"),
    Suspicion("dead_table", ("events",), None, "only dates to come"),
    Suspicion("dead_table", ("customer",), None, "nothing to date it by"),
    Suspicion("dead_table", ("archived",), None, "no row"),
    Suspicion("inconsistent_values", ("documents",), "lang", "en / EN"),
    Suspicion("inconsistent_values", ("documents",), "text", "texts"),
    Suspicion("inconsistent_values", ("orders",), "o_orderpriority", "spellings"),
    Suspicion("inconsistent_values", ("customer",), "c_name", "names"),
    Suspicion("inconsistent_values", ("archived",), "l_returnflag", "no row"),
    Suspicion("duplicate_entity", ("documents", "labels"), None, "same key"),
    Suspicion("duplicate_entity", ("documents", "benchmark"), None, "same texts"),
    Suspicion("duplicate_entity", ("lineitem", "returned"), None, "a copy of a part"),
    Suspicion("missing_key", ("lineitem",), None, "no key"),
    Suspicion("missing_key", ("orders",), None, "no key"),
    Suspicion("other", ("region",), None, "cannot be measured"),
]


_OPENED: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test tables with their keys, and the derived relations; opened once per application, read by every query."""
    opened = (spark.sparkContext.applicationId, sf_dir)
    if opened not in _OPENED:
        base = Catalog.from_parquet(spark, sf_dir, TABLES, KEYS)
        lines = base["lineitem"].df
        derived = [Relation("returned", lines.where("l_returnflag = 'R'")), Relation("archived", lines.where("l_quantity < 0"))]
        _OPENED[opened] = Catalog(spark, [*base.relations, *derived], KEYS)
    return _OPENED[opened]


def mixed_case(cat: Catalog) -> Catalog:
    """The catalog with spellings that differ in documents and events, by what the rows themselves hold."""
    documents = cat["documents"].df.withColumn("lang", F.expr("if(n_chars > 1000, upper(lang), concat(lang, if(n_chars < 100, ' ', '')))"))
    events = cat["events"].df.withColumn("event_type", F.expr("if(value > 50, initcap(event_type), event_type)"))
    return cat.replace(documents=documents, events=events)
