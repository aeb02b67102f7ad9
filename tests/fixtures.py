"""Small tables with seeded problems, every row a formula of its number."""

from datetime import datetime

from pyspark.sql import functions as F

from plumbline import Catalog, Relation
from plumbline.operators.joins import Relationship
from plumbline.operators.problems import Suspicion

AS_OF = datetime(2026, 7, 1)
CANARY = "canary-pii"


def rows(spark, first, last, *columns):
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("i")).selectExpr(*columns)


def one_of(*values):
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def ago(unit):
    return f"timestamp_ntz'2026-07-01 00:00:00' - make_interval(0, 0, 0, {'i' if unit == 'days' else 0}, {'i' if unit == 'hours' else 0}, {'i' if unit == 'minutes' else 0}, 0)"


def shop(spark):
    """The tables of a shop: broken and confirmed joins, an empty table, mixed spellings, a copy, a missing key."""
    customers = rows(
        spark, 1, 250, "i AS id", f"concat('{CANARY} Person ', i) AS full_name", f"concat('person', i, '@{CANARY}.example') AS email",
        f"if(i % 10 = 0, null, concat(i, ' {CANARY} Street')) AS address", f"{one_of('CZ', 'SK', 'DE', 'AT')}[i % 4] AS country",
        f"{ago('hours')} AS created_at", f"'{CANARY}-0123456789abcdef01234' AS api_token",
    )
    orders = rows(
        spark, 1, 500, "i AS id", "if(i % 25 < 3, 9000 + i, 1 + i % 250) AS customer_id",
        f"{one_of('shipped', 'SHIPPED', 'pending', 'cancelled', 'Pending')}[i % 5] AS status", "(i * 37) % 20000 + 100 AS total_cents",
        f"{ago('hours')} AS created_at",
    )
    products = rows(
        spark, 1, 80, "i AS id", "concat('SKU-', lpad(i, 5, '0')) AS sku", "concat('Product ', i) AS name",
        f"{one_of('tools', 'parts', 'fluids')}[i % 3] AS category", "i * 150 AS price_cents",
    )
    order_items = rows(spark, 1, 1200, "i AS id", "1 + i % 500 AS order_id", "1 + i % 80 AS product_id", "1 + i % 5 AS quantity")
    vehicles = rows(
        spark, 1, 120, "i AS id", "concat('VIN', lpad(i, 14, '0')) AS vin", f"{one_of('Skoda', 'Volkswagen', 'Toyota', 'Ford')}[i % 4] AS make",
        "2010 + i % 14 AS model_year", "1 + i % 250 AS customer_id", f"{ago('days')} AS registered_at",
    )
    audit_log = rows(
        spark, 1, 300, f"{one_of('order', 'customer', 'vehicle')}[i % 3] AS entity", "1 + i % 100 AS entity_id",
        f"{one_of('insert', 'update', 'delete', 'login')}[i % 4] AS action", f"{ago('minutes')} AS happened_at",
    )
    events = rows(
        spark, 1, 300, "i AS id", "date_add(date'2025-01-01', i % 600) AS happened_on", f"{one_of('click', 'view', 'buy')}[i % 3] AS kind"
    )
    totals = spark.range(0).selectExpr("cast(id AS int) AS customer_id", "id AS orders", "id AS total_cents").schema
    tables = dict(
        customers=customers, orders=orders, products=products, products_legacy=products.where("id <= 70"), order_items=order_items,
        vehicles=vehicles, cars=vehicles.where("false"), audit_log=audit_log, events=events,
    )
    relations = [Relation(name, df) for name, df in tables.items()]
    relations.append(Relation("shipped_orders", orders.where("lower(trim(status)) = 'shipped'"), kind="view", definition="SELECT shipped"))
    relations.append(Relation("order_totals", None, kind="materialized view", definition="SELECT totals", columns=totals))
    keys = [(t, "p", 0, "id", None, None) for t in ("customers", "orders", "products", "products_legacy", "order_items", "vehicles", "cars", "events")]
    keys += [
        ("events", "p", 1, "happened_on", None, None),
        ("order_items", "f", 0, "order_id", "orders", "id"),
        ("order_items", "f", 0, "product_id", "products", "id"),
        ("vehicles", "f", 0, "customer_id", "customers", "id"),
    ]
    return Catalog(spark, relations, keys)


SHOP_JOINS = [
    Relationship("orders", "customer_id", "customers", "id", confidence=0.8, reason="name"),
    Relationship("order_items", "order_id", "orders", "id", basis="stated", confidence=1.0, reason="fk"),
    Relationship("vehicles", "model_year", "customers", "id", confidence=0.2, reason="a guess the data rejects"),
    Relationship("cars", "customer_id", "customers", "id", confidence=0.5, reason="nothing to test"),
    Relationship("customers", "address", "customers", "full_name", confidence=0.1, reason="nulls, pointing nowhere"),
]
QUANTITY = Relationship("order_items", "quantity", "products", "id", confidence=0.9, reason="name")
SHOP_PROBLEMS = [
    Suspicion("dead_table", ("cars",), None, "empty beside vehicles"),
    Suspicion("inconsistent_values", ("orders",), "status", "shipped / SHIPPED"),
    Suspicion("inconsistent_values", ("cars",), "make", "nothing to measure"),
    Suspicion("duplicate_entity", ("products", "products_legacy"), None, "same columns and values"),
    Suspicion("missing_key", ("audit_log",), None, "no primary key"),
    Suspicion("dead_table", ("order_totals",), None, "never refreshed"),
    Suspicion("other", ("customers",), None, "cannot be measured"),
]


def polymorph(spark):
    """A polymorphic reference, orphans inside a sparse key's range and orphans below it."""
    tables = dict(
        posts=rows(spark, 1, 100, "i AS id", f"concat('{CANARY} post ', i) AS title"),
        photos=rows(spark, 1, 40, "i AS id", f"concat('{CANARY} photo ', i) AS caption"),
        comments=rows(
            spark, 1, 480, "i AS id", "if(i <= 300, 'post', 'photo') AS commentable_type",
            "if(i <= 300, 1 + i % 100, 1 + i % 60) AS commentable_id", f"concat('{CANARY} comment ', i) AS body",
        ),
        accounts=rows(spark, 1, 50, "i AS id", f"concat('{CANARY} account ', i) AS name").where("id NOT BETWEEN 10 AND 19"),
        invoices=rows(spark, 1, 200, "i AS id", "1 + i % 50 AS account_id"),
        refunds=rows(spark, 1, 20, "if(i <= 5, -i, 15 + i) AS account_id"),
    )
    keys = [(t, "p", 0, "id", None, None) for t in tables if t != "refunds"]
    return Catalog(spark, [Relation(n, d) for n, d in tables.items()], keys)


def on_disk(catalog, directory):
    """The same catalog over Parquet files, each table in a few of them."""
    written = {}
    for r in catalog.relations:
        if r.df is not None:
            path = f"{directory}/{r.name}.parquet"
            r.df.repartition(3).write.parquet(path)
            written[r.name] = Relation(r.name, catalog.spark.read.parquet(path), r.schema, r.kind, r.definition, files=path)
    return Catalog(catalog.spark, [written.get(r.name, r) for r in catalog.relations], catalog.keys, catalog.reveal)
