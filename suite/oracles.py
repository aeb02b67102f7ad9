"""SQL that gives each query's rows from the tables alone, written out from the same claims."""

from __future__ import annotations

from suite.inputs import (
    BRANCH_TARGETS,
    CLAIMS,
    CLICKS_SUPPLIER,
    CUSTOMER_SUPPLIER,
    DERIVED,
    EVENTS_SUPPLIER,
    FOREIGN,
    LINENUMBER,
    LINES_ORDERS,
    ORDERS_CUSTOMER,
    PART_CUSTOMER,
    PRIMARY,
    SUSPICIONS,
    TABLES,
    TEXT_FALLBACK,
    Relationship,
    Suspicion,
)
from suite.queries import KEPT_CLAIMS, KEPT_SUSPICIONS, SAMPLE_KEY

ORACLES: dict[str, str] = {}

# The columns of the test tables: b bigint, i int, d double, t text, s timestamp, a array.
COLUMNS = {
    "region": "i r_regionkey, t r_name",
    "nation": "i n_nationkey, t n_name, i n_regionkey",
    "customer": "b c_custkey, t c_name, i c_nationkey, d c_acctbal, t c_mktsegment",
    "supplier": "b s_suppkey, t s_name, i s_nationkey, d s_acctbal",
    "part": "b p_partkey, t p_name, t p_brand, t p_type, i p_size, d p_retailprice",
    "orders": "b o_orderkey, b o_custkey, t o_orderstatus, d o_totalprice, s o_orderdate, t o_orderpriority",
    "lineitem": "b l_orderkey, b l_partkey, b l_suppkey, i l_linenumber, d l_quantity, d l_extendedprice, d l_discount, d l_tax, t l_returnflag, t l_linestatus, s l_shipdate",
    "events": "b event_id, s ts, b user_id, t event_type, d value, t props",
    "documents": "b doc_id, t text, t lang, t source, b n_chars",
    "embeddings": "b vec_id, a embedding, i label",
    "pages": "b page_id, t url, t html",
    "benchmark": "b item_id, t text",
    "labels": "b doc_id, i quality, i toxic",
    "conversations": "b conv_id, b turn, t role, t text",
}
COLUMNS = {t: [tuple(c.split()) for c in text.split(", ")] for t, text in COLUMNS.items()}
COLUMNS["returned"] = COLUMNS["archived"] = COLUMNS["lineitem"]
MIXED_DOCUMENTS = "SELECT * REPLACE (CASE WHEN n_chars > 1000 THEN upper(lang) ELSE lang || CASE WHEN n_chars < 100 THEN ' ' ELSE '' END END AS lang) FROM documents"
MIXED_EVENTS = "SELECT * REPLACE (CASE WHEN value > 50 THEN upper(event_type[1]) || event_type[2:] ELSE event_type END AS event_type) FROM events"
LATER_CUSTOMER = "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'"
LATER = {"customer": LATER_CUSTOMER, "documents": MIXED_DOCUMENTS, "vip": LATER_CUSTOMER}
GONE = {"labels": None, "orders": "o_orderpriority"}
AS_OF = "TIMESTAMP '2002-01-01 00:00:00'"


def rel(name: str, env: dict[str, str] | None = None) -> str:
    text = (env or {}).get(name) or DERIVED.get(name)
    return f"({text})" if text else name


def lit(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def kind_of(table: str, column: str) -> str:
    return next(k for k, c in COLUMNS[table] if c == column)


# ---- joins ----


def counts(r: Relationship, env=None) -> str:
    """One row: total, nulls, hits, above, below, lo, hi."""
    cast = "::VARCHAR" if kind_of(r.from_table, r.from_column) == "t" or kind_of(r.to_table, r.to_column) == "t" else ""
    where = f" WHERE {r.when_column}::VARCHAR = {lit(r.when_equals)}" if r.when_column else ""
    c, t, to = f"f.{r.from_column}", r.to_column, rel(r.to_table, env)
    ends = "CAST(NULL AS BIGINT) AS above, CAST(NULL AS BIGINT) AS below"
    if not cast and PRIMARY.get(r.to_table, [None])[0] == t:
        ends = f"count(*) FILTER (WHERE {c} > (SELECT max({t}) FROM {to})) AS above, count(*) FILTER (WHERE {c} < (SELECT min({t}) FROM {to})) AS below"
    return (
        f"SELECT count({c}) AS total, count(*) - count({c}) AS nulls, count(t.v) AS hits, {ends}, min({c})::BIGINT AS lo, max({c})::BIGINT AS hi "
        f"FROM (SELECT * FROM {rel(r.from_table, env)}{where}) f LEFT JOIN (SELECT DISTINCT {t}{cast} AS v FROM {to}) t ON t.v = {c}{cast}"
    )


RATES = (
    "total, nulls, CASE WHEN total > 0 THEN hits END AS hits, CASE WHEN total > 0 THEN total - hits END AS orphans,"
    " CASE WHEN total > 0 THEN hits / total END AS hit, CASE WHEN total > 0 THEN above END AS orphans_above,"
    " CASE WHEN total > 0 THEN below END AS orphans_below"
)


def hit_rate(r: Relationship) -> str:
    return f"SELECT {RATES} FROM ({counts(r)}) m"


for name, claim in {
    "join_hit_rate_orders_customer": ORDERS_CUSTOMER,
    "join_broken_part_customer": PART_CUSTOMER,
    "join_rejected_customer_supplier": CUSTOMER_SUPPLIER,
    "join_when_click_events_supplier": CLICKS_SUPPLIER,
    "join_text_fallback": TEXT_FALLBACK,
    "join_keyed_lineitem_orders": LINES_ORDERS,
}.items():
    ORACLES[name] = hit_rate(claim)

ORACLES["orphan_rows_part_customer"] = "SELECT * FROM part WHERE p_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey)"
ORACLES["orphan_rows_lines_customer"] = f"SELECT {', '.join(SAMPLE_KEY)} FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey)"
ORACLES["join_by_event_type_targets"] = " UNION ALL ".join(
    f"SELECT '{branch}' AS branch, '{t}' AS to_table, {RATES} FROM ({counts(Relationship('events', 'user_id', t, c, 'event_type', branch))}) m WHERE total + nulls > 0"
    for branch, (t, c) in BRANCH_TARGETS.items()
)
ORACLES["orphan_placement_events_supplier"] = (
    f"SELECT orphans, orphans_above, orphans_below, orphans - orphans_above - orphans_below AS orphans_inside FROM ({hit_rate(EVENTS_SUPPLIER)}) o"
)
ORACLES["join_by_event_type"] = (
    "SELECT branch, total, nulls, CASE WHEN total > 0 THEN hits END AS hits, CASE WHEN total > 0 THEN total - hits END AS orphans,"
    " CASE WHEN total > 0 THEN hits / total END AS hit FROM (SELECT event_type AS branch, count(user_id) AS total, count(*) - count(user_id) AS nulls,"
    " count(v) AS hits FROM events LEFT JOIN (SELECT DISTINCT s_suppkey AS v FROM supplier) ON v = user_id GROUP BY event_type) m"
)


def dense(env=None) -> str:
    single = [(t, c[0]) for t, c in PRIMARY.items() if len(c) == 1]
    every = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, count(*) AS n, min({c})::BIGINT AS lo, max({c})::BIGINT AS hi FROM {rel(t, env)}" for t, c in single)
    return f"SELECT * FROM ({every}) k WHERE lo IS NOT NULL AND n >= 0.9::DOUBLE * (hi - lo + 1)"


ORACLES["dense_keys"] = f'SELECT tab AS "table", col AS "column", n AS rows, lo, hi FROM ({dense()}) d'


def allowed(table: str, column: str, env=None) -> str:
    c = f"{column}::VARCHAR"
    return (
        f"(SELECT count(DISTINCT {c}) BETWEEN 1 AND 50 AND max(length({c})) <= 30 AND count(DISTINCT {c}) < count({c})"
        f" AND count({c}) >= 2 * count(DISTINCT {c}) FROM {rel(table, env)})"
    )


def unknown(r: Relationship, gone: dict | None = None) -> str | None:
    gone = gone or {}
    known = {t: [c for _, c in cols if gone.get(t, "") != c] for t, cols in COLUMNS.items() if gone.get(t, "") is not None}
    for t in (r.from_table, r.to_table):
        if t not in known:
            return f"unknown table {t}"
    for t, c in ((r.from_table, r.from_column), (r.to_table, r.to_column), (r.from_table, r.when_column)):
        if c is not None and c not in known[t]:
            return f"unknown column {t}.{c}"
    return None


def measured(claims: list[Relationship], env=None, gone=None, foreign=FOREIGN) -> str:
    """A verdict per claim, from the counts of each."""
    rows = []
    for r in claims:
        head = f"SELECT {lit(r.claim_id)} AS claim_id, {lit(r.basis)} AS basis, {lit(r.from_table)} AS ft, {lit(r.from_column)} AS fc, {lit(r.to_table)} AS tt, {lit(r.to_column)} AS tc"
        head += f", {lit(r.when_column)} AS wc, {lit(r.when_equals)} AS we"
        why = unknown(r, gone)
        if why:
            rows.append(f"{head}, {lit(why)} AS why, false AS weighed, NULL AS from_rows, NULL AS to_rows, true AS ok, NULL AS total, NULL AS nulls, NULL AS hits, NULL AS above, NULL AS below, NULL AS lo, NULL AS hi")
            continue
        weighed = r.basis == "inferred" and kind_of(r.from_table, r.from_column) in "bi" and (r.from_table, r.from_column, r.to_table, r.to_column) not in foreign
        ok = allowed(r.from_table, r.when_column, env) if r.when_column else "true"
        rows.append(
            f"{head}, CAST(NULL AS VARCHAR) AS why, {str(weighed).lower()} AS weighed, (SELECT count(*) FROM {rel(r.from_table, env)}) AS from_rows,"
            f" (SELECT count(*) FROM {rel(r.to_table, env)}) AS to_rows, {ok} AS ok, m.* FROM ({counts(r, env)}) m"
        )
    fits = "d.tab <> tt AND NOT (d.tab = ft AND d.col = fc)"
    return f"""
WITH d AS ({dense(env)}), raw AS ({" UNION ALL ".join(rows)}),
told AS (SELECT *, why IS NULL AND ok AND from_rows > 0 AND to_rows > 0 AS t FROM raw),
n AS (SELECT claim_id, basis, ft, fc, tt, tc, wc, we, weighed, lo, hi,
  CASE WHEN t THEN total END AS total, CASE WHEN t THEN nulls END AS nulls,
  CASE WHEN t AND total > 0 THEN hits END AS hits, CASE WHEN t AND total > 0 THEN total - hits END AS orphans,
  CASE WHEN t AND total > 0 THEN hits / total END AS hit,
  CASE WHEN t AND total > 0 THEN above END AS orphans_above, CASE WHEN t AND total > 0 THEN below END AS orphans_below,
  CASE WHEN why IS NOT NULL THEN why WHEN from_rows = 0 THEN 'no non-null rows to test' WHEN to_rows = 0 THEN 'no rows to match against'
    WHEN NOT ok THEN ft || '.' || wc || ' is not categorical, so no condition on it is measured'
    WHEN total = 0 THEN 'no non-null rows to test' END AS skipped,
  why IS NULL AND (from_rows = 0 OR to_rows = 0 OR (ok AND total = 0)) AS empty FROM told),
w AS (SELECT *, weighed AND skipped IS NULL AND hit >= 0.95 AS judged FROM n)
SELECT claim_id, total, nulls, hits, orphans, hit, orphans_above, orphans_below,
  CASE WHEN judged THEN nullif((SELECT count(*) FROM d WHERE {fits}), 0) END AS candidates,
  CASE WHEN judged AND (SELECT count(*) FROM d WHERE {fits}) > 0 THEN (SELECT count(*) FROM d WHERE {fits} AND d.lo <= w.lo AND d.hi >= w.hi) END AS also_fits,
  skipped, empty,
  CASE WHEN skipped IS NOT NULL THEN CASE WHEN empty THEN 'empty' ELSE 'unverifiable' END
    WHEN hit >= 0.95 THEN 'confirmed' WHEN hit >= 0.5 THEN 'broken' ELSE 'rejected' END AS status,
  basis, ft, fc, tt, tc, wc, we FROM w"""


VERDICT = "claim_id, total, nulls, hits, orphans, hit, orphans_above, orphans_below, candidates, also_fits, skipped, empty, status"
ORACLES["weak_evidence_linenumber"] = f"SELECT claim_id, total, hits, candidates, also_fits, status FROM ({measured([LINENUMBER])}) v"
ORACLES["measure_claims_all"] = f"SELECT {VERDICT} FROM ({measured(CLAIMS)}) v"
ORACLES["measure_claims_long_form"] = ORACLES["measure_claims_all"]
ORACLES["declared_joins"] = f"SELECT {VERDICT} FROM ({measured([Relationship(*f, basis='stated') for f in FOREIGN])}) v"

PCT = "printf('%.1f', {} * 100) || '%'"
HIT = PCT.format("hit")
SPOTS = (
    "list_filter([CASE WHEN orphans_above > 0 THEN CASE WHEN orphans_above = orphans THEN 'all' ELSE orphans_above::VARCHAR END || ' above the highest ' || tt || '.' || tc END,"
    " CASE WHEN orphans_below > 0 THEN CASE WHEN orphans_below = orphans THEN 'all' ELSE orphans_below::VARCHAR END || ' below the lowest ' || tt || '.' || tc END,"
    " CASE WHEN orphans - orphans_above - orphans_below > 0 THEN CASE WHEN orphans_above = 0 AND orphans_below = 0 THEN 'all' ELSE (orphans - orphans_above - orphans_below)::VARCHAR END"
    " || ' inside the ' || tt || '.' || tc || ' range' END], lambda x: x IS NOT NULL)"
)
SPOT = (
    f"CASE WHEN orphans_above IS NULL THEN '' ELSE ', ' || CASE len({SPOTS}) WHEN 0 THEN '' WHEN 1 THEN ({SPOTS})[1]"
    f" WHEN 2 THEN ({SPOTS})[1] || ' and ' || ({SPOTS})[2] ELSE ({SPOTS})[1] || ', ' || ({SPOTS})[2] || ', and ' || ({SPOTS})[3] END END"
)
INFERRED = "CASE WHEN basis = 'stated' THEN '' ELSE ' (inferred)' END"
EDGE = "ft || '.' || fc || ' -> ' || tt || '.' || tc || coalesce(' when ' || wc || ' = ''' || replace(we, '''', '''''') || '''', '')"
NULLS = f"CASE WHEN nulls > 0 THEN ' ' || nulls || ' rows (' || {PCT.format('(nulls / (total + nulls))')} || ') have no ' || fc || '; an inner join drops them too.' ELSE '' END"
WHY = "CASE WHEN skipped IS NOT NULL THEN 'not measured: ' || skipped ELSE status END"
SENTENCE = f"""CASE
  WHEN status = 'confirmed' AND also_fits > 0 THEN {EDGE} || ': confirmed on weak evidence, ' || {HIT} || ' of ' || total || ' rows match, but the same values would also match ' || also_fits
    || ' other ' || CASE WHEN also_fits = 1 THEN 'key' ELSE 'keys' END || ', so the match alone does not prove this join (inferred).' || {NULLS}
  WHEN status = 'confirmed' THEN {EDGE} || ': confirmed, ' || {HIT} || ' of ' || total || ' rows match' || {INFERRED} || '.' || {NULLS}
  WHEN status = 'broken' THEN '**BROKEN** ' || {EDGE} || ': ' || {HIT} || ' match (' || hits || ' of ' || total || ' rows), ' || orphans || ' orphans' || {SPOT} || {INFERRED}
    || '. An inner join drops the orphans: use LEFT JOIN, or filter them on purpose.' || {NULLS}
  WHEN status = 'rejected' THEN {EDGE} || ': rejected, ' || {HIT} || ' of ' || total || ' rows match: these columns do not relate; find the right key.'
  ELSE {EDGE} || ' (' || CASE WHEN basis = 'stated' THEN '' ELSE 'inferred, ' END || {WHY} || ')' END"""
JOIN_LINES = f"SELECT claim_id, ft AS from_table, tt AS to_table, status, {SENTENCE} AS line FROM ({measured(CLAIMS)}) v"
ORACLES["join_lines"] = JOIN_LINES
ORACLES["measure_join_single"] = f"SELECT claim_id, total, nulls, hits, orphans, hit, orphans_above, orphans_below, status, {SENTENCE} AS line FROM ({measured([PART_CUSTOMER])}) v"

# One branch per value of event_type: the branches are only known from the data, so they are grouped, not listed.
ORACLES["branch_claims_events"] = f"""
WITH d AS ({dense()}), e AS (SELECT * FROM events WHERE event_type IS NOT NULL AND {allowed("events", "event_type")}),
m AS (SELECT event_type, count(user_id) AS total, count(*) - count(user_id) AS nulls, count(v) AS hits,
  count(*) FILTER (WHERE user_id > (SELECT max(s_suppkey) FROM supplier)) AS above,
  count(*) FILTER (WHERE user_id < (SELECT min(s_suppkey) FROM supplier)) AS below, min(user_id) AS lo, max(user_id) AS hi
  FROM e LEFT JOIN (SELECT DISTINCT s_suppkey AS v FROM supplier) ON v = user_id GROUP BY event_type),
n AS (SELECT event_type, {RATES}, lo, hi FROM m)
SELECT 'relationship:events.user_id->supplier.s_suppkey[event_type=' || event_type || ']' AS claim_id, total, nulls, hits, orphans, hit, orphans_above, orphans_below,
  CASE WHEN hit >= 0.95 THEN nullif((SELECT count(*) FROM d WHERE tab <> 'supplier'), 0) END AS candidates,
  CASE WHEN hit >= 0.95 THEN (SELECT count(*) FROM d WHERE tab <> 'supplier' AND d.lo <= n.lo AND d.hi >= n.hi) END AS also_fits,
  CASE WHEN total = 0 THEN 'no non-null rows to test' END AS skipped, total = 0 AS empty,
  CASE WHEN total = 0 THEN 'empty' WHEN hit >= 0.95 THEN 'confirmed' WHEN hit >= 0.5 THEN 'broken' ELSE 'rejected' END AS status FROM n"""


# ---- profiles ----


def profiled(tables=None, env=None) -> str:
    """A row per column, with the value list of a categorical one."""
    rows = []
    for t in tables or COLUMNS:
        keyed = {*PRIMARY.get(t, ()), *(c for ft, c, *_ in FOREIGN if ft == t)}
        for i, (k, c) in enumerate(COLUMNS[t]):
            text = f"{c}::VARCHAR"
            years = f"year(min({c})), year(max({c}))" if k == "s" else "NULL::BIGINT, NULL::BIGINT"
            fam = {"t": "text", "s": "time"}.get(k, "other")
            rows.append(
                f"SELECT '{t}', {i}, '{c}', '{k}', '{fam}', {str(c in keyed and fam != 'text').lower()}, count(*), count({c}), count(DISTINCT {text}),"
                f" max(length({text})), {years} FROM {rel(t, env)}"
            )
    names = 'p("table", ordinal, "column", k, family, keyed, rows, non_null, "distinct", max_length, y0, y1)'
    return f"""
SELECT *, categorical OR keyed AS visible FROM (SELECT *, CASE WHEN rows = 0 THEN 0.0::DOUBLE ELSE 1 - non_null / rows END AS null_rate,
  "distinct" BETWEEN 1 AND 50 AND max_length <= 30 AND "distinct" < non_null AND non_null >= 2 * "distinct" AS categorical
  FROM ({" UNION ALL ".join(rows)}) {names}) q"""


HEAD = '"table", ordinal::INT AS ordinal, "column", true AS nullable, family, rows, non_null, null_rate, "distinct"'
ORACLES["profile_all"] = f"SELECT {HEAD} FROM ({profiled()}) p"
ORACLES["profile_orders"] = f"SELECT {HEAD}, max_length, categorical, visible FROM ({profiled(['orders'])}) p"
ORACLES["profile_text_lengths"] = f"""SELECT "table", "column", "distinct", coalesce(max_length, 0) AS max_length FROM ({profiled()}) p WHERE family = 'text'"""
ORACLES["profile_customer_categorical"] = f"""SELECT "column", "distinct" FROM ({profiled(['customer'])}) p WHERE categorical"""
ORACLES["visibility_all"] = f"""SELECT "table", "column", coalesce(categorical, false) AS categorical, coalesce(visible, keyed) AS visible FROM ({profiled()}) p"""
ORACLES["year_ranges"] = f"""SELECT "table", "column", y0::INT AS year_min, y1::INT AS year_max FROM ({profiled()}) p WHERE NOT visible AND y0 IS NOT NULL"""


def value_lists(tables=None, item="v", env=None) -> str:
    """(table, column, values) of every categorical column."""
    rows = []
    for t in tables or COLUMNS:
        for _, c in (x for x in COLUMNS[t] if x[0] != "a"):
            rows.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", string_agg({item}, ', ' ORDER BY v) AS values FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {rel(t, env)}) WHERE v IS NOT NULL AND {allowed(t, c, env)}""")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) l WHERE values IS NOT NULL"


ORACLES["describe_part"] = f"""
SELECT 'part' AS "table", 'table' AS kind, true AS populated, NULL::BIGINT AS partitions, rows AS row_estimate, 'count' AS estimate_source, 'p_partkey' AS primary_key, '' AS foreign_keys,
  p.ordinal::INT AS ordinal, p."column" AS "column", CASE k WHEN 'b' THEN 'bigint' WHEN 'i' THEN 'int' WHEN 'd' THEN 'double' ELSE 'string' END AS type, true AS nullable, null_rate, "distinct", l.values, NULL::VARCHAR AS unmeasured
FROM ({profiled(['part'])}) p LEFT JOIN ({value_lists(['part'])}) l ON l."column" = p."column\""""
ORACLES["profile_values_all"] = f"""
SELECT p."table", p."column", "distinct", l.values FROM ({profiled()}) p JOIN ({value_lists()}) l ON l."table" = p."table" AND l."column" = p."column" WHERE k NOT IN ('s', 'd')"""
ORACLES["value_lists_lineitem"] = f'SELECT "column", values FROM ({value_lists(["lineitem"])}) l'
# The table is one file, in whose order it is read.
ORACLES["redacted_sample_customer"] = """
SELECT c_custkey::VARCHAR AS c_custkey, '[hidden]' AS c_name, c_nationkey::VARCHAR AS c_nationkey, '[hidden]' AS c_acctbal, c_mktsegment
FROM (SELECT *, row_number() OVER () - 1 AS place FROM customer) c ORDER BY substr(md5('1|customer.parquet|' || place::VARCHAR), 1, 8), place LIMIT 15"""


# ---- sizes and samples ----

SIZES = " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {rel(t)}""" for t in [*TABLES, *DERIVED])
ORACLES["row_counts"] = SIZES
# Every table of the test data is one file, so the pilot reads it all.
ORACLES["pilot_estimate"] = """SELECT 'lineitem' AS "table", count(*) AS rows, 'pilot' AS source FROM lineitem"""
# So every part of a table is known too.
ORACLES["partition_estimate"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS rows, 'partitions' AS source FROM {t}""" for t in ("documents", "lineitem", "orders", "events")
)
_KEY = ", ".join(f"{c}::VARCHAR" for c in SAMPLE_KEY)
SAMPLE = f"SELECT * FROM lineitem WHERE substr(md5(concat_ws('|', '1', {_KEY})), 1, 8) < '{int(0.1 * 16**8):08x}'"
ORACLES["repeatable_sample_lineitem"] = f"SELECT {', '.join(SAMPLE_KEY)} FROM ({SAMPLE}) s"
ORACLES["sample_cap_lineitem"] = "SELECT o_orderkey FROM orders ORDER BY substr(md5(concat_ws('|', '1', o_orderkey::VARCHAR)), 1, 8) LIMIT 100"
ORACLES["sample_fallback_size"] = "SELECT CASE WHEN count(*) < 500 THEN count(*) ELSE -1 END AS rows, count(*) < 500 AS is_count FROM (SELECT * FROM orders LIMIT 500) s"
ORACLES["join_on_sample_lineitem"] = f"SELECT {RATES} FROM ({counts(Relationship('lineitem', 'l_partkey', 'customer', 'c_custkey'), {'lineitem': SAMPLE})}) m"

_ORDERS_SAMPLE = """SELECT * FROM orders WHERE substr(md5('1|' || o_orderkey::VARCHAR), 1, 8)
  < (SELECT CASE WHEN count(*) <= 1000 THEN 'g' ELSE printf('%08x', floor(1000.0::DOUBLE / count(*) * 4294967296)::BIGINT) END FROM orders)"""
ORACLES["profile_orders_sampled"] = f"SELECT {HEAD} FROM ({profiled(['orders'], {'orders': _ORDERS_SAMPLE})}) p"
ORACLES["claims_sampled"] = f"SELECT {VERDICT} FROM ({measured([ORDERS_CUSTOMER], {'orders': _ORDERS_SAMPLE})}) v"


# ---- problems ----


def age(table: str) -> str:
    times = [c for k, c in COLUMNS[table] if k == "s"]
    if not times:
        return "NULL::BIGINT"
    newest = ", ".join(f"max(epoch_us({c})) FILTER (WHERE {c} <= {AS_OF})" for c in times)
    return f"ceil((epoch_us({AS_OF}) - greatest({newest})) / 86400000000.0)::BIGINT"


ORACLES["dead_tables_as_of"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS row_count, {age(t)} AS age_days FROM {rel(t)}""" for t in ("orders", "lineitem", "events", "customer", "archived")
)

PROBLEM_TYPES = {
    "exact": "INTEGER", "row_count": "BIGINT", "age_days": "BIGINT", "distinct_values": "BIGINT", "canonical_forms": "BIGINT", "collisions": "BIGINT",
    "total": "BIGINT", "matched": "BIGINT", "shared_columns": "INTEGER", "overlap": "DOUBLE", "total_reverse": "BIGINT", "matched_reverse": "BIGINT",
    "overlap_reverse": "DOUBLE", "has_primary_key": "INTEGER",
}


def spread(s: Suspicion, sql: str, given: str, skipped: str = "CAST(NULL AS VARCHAR)", empty: str = "false", over: bool = True) -> str:
    """One suspicion's row: the numbers a statement gives, null for the others."""
    have = given.split()
    columns = ", ".join(f"{n if n in have else 'NULL'}::{t} AS {n}" for n, t in PROBLEM_TYPES.items())
    named = lit(s.tables[0]) if len(s.tables) > 1 and over else "CAST(NULL AS VARCHAR)"
    return f"SELECT {lit(s.claim_id)} AS claim_id, {lit(s.kind)} AS kind, {named} AS over, {columns}, {skipped} AS skipped, {empty} AS empty FROM ({sql}) m"


def problem(s: Suspicion, env=None, gone=None) -> str:
    t, gone = s.tables[0], gone or {}
    if s.kind == "dead_table":
        return spread(s, f"SELECT 1 AS exact, count(*) AS row_count, {age(t)} AS age_days FROM {rel(t, env)}", "exact row_count age_days")
    if s.kind == "missing_key":
        return spread(s, f"SELECT {int(t in PRIMARY)} AS has_primary_key", "has_primary_key")
    if s.kind == "inconsistent_values":
        if gone.get(t) == s.column:
            return spread(s, "SELECT 1", "", lit(f"unknown column {t}.{s.column}"))
        inner = f"SELECT count(*) AS n, count(DISTINCT {s.column}) AS dv, count(DISTINCT lower(trim({s.column}))) AS cf FROM {rel(t, env)}"
        sql = f"SELECT n, CASE WHEN n > 0 THEN dv END AS distinct_values, CASE WHEN n > 0 THEN cf END AS canonical_forms, CASE WHEN n > 0 THEN dv - cf END AS collisions FROM ({inner}) i"
        skipped = "CASE WHEN n = 0 OR distinct_values = 0 THEN 'no non-null rows to test' WHEN distinct_values > 50 THEN 'not categorical: ' || distinct_values || ' distinct values' END"
        return spread(s, sql, "distinct_values canonical_forms collisions", skipped, "n = 0 OR distinct_values = 0")
    if s.kind == "duplicate_entity":
        a, b = s.tables
        if any(x in gone and gone[x] is None for x in (a, b)):
            return spread(s, "SELECT 1", "", lit(f"needs two known tables, got {a}, {b}"))
        shared = [c for _, c in COLUMNS[a] if c in {x for _, x in COLUMNS[b]}]
        cols = ", ".join(shared)
        sql = f"""SELECT *, matched / total AS overlap, matched AS matched_reverse, matched / total_reverse AS overlap_reverse FROM (SELECT
          (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {rel(a, env)})) AS total, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {rel(b, env)})) AS total_reverse,
          (SELECT count(*) FROM (SELECT {cols} FROM {rel(a, env)} INTERSECT SELECT {cols} FROM {rel(b, env)})) AS matched, {len(shared)} AS shared_columns) o"""
        return spread(s, sql, "total matched shared_columns overlap total_reverse matched_reverse overlap_reverse")
    return spread(s, "SELECT 1", "", "'no measurement exists for this kind of suspicion'", over=False)


def problems(suspicions: list[Suspicion], env=None, gone=None) -> str:
    return f"""
SELECT *, CASE WHEN skipped IS NOT NULL THEN CASE WHEN empty THEN 'empty' ELSE 'unverifiable' END
  WHEN kind = 'dead_table' THEN CASE WHEN row_count = 0 OR coalesce(age_days > 90, false) THEN 'confirmed' ELSE 'rejected' END
  WHEN kind = 'inconsistent_values' THEN CASE WHEN collisions > 0 THEN 'confirmed' ELSE 'rejected' END
  WHEN kind = 'duplicate_entity' THEN CASE WHEN greatest(overlap, overlap_reverse) >= 0.7 THEN 'confirmed' ELSE 'rejected' END
  WHEN kind = 'missing_key' THEN CASE WHEN has_primary_key = 0 THEN 'confirmed' ELSE 'rejected' END ELSE 'unverifiable' END AS status
FROM ({" UNION ALL ".join(problem(s, env, gone) for s in suspicions)}) s"""


ORACLES["suspicions_all"] = f"SELECT * EXCLUDE (kind) FROM ({problems(SUSPICIONS)}) p"
MIXED = {"documents": MIXED_DOCUMENTS, "events": MIXED_EVENTS}
_MIXED = [Suspicion("inconsistent_values", (t,), c) for t, c in (("documents", "lang"), ("documents", "source"), ("events", "event_type"))]
ORACLES["inconsistent_values_docs"] = f"SELECT claim_id, distinct_values, canonical_forms, collisions, status FROM ({problems(_MIXED, MIXED)}) p"
ORACLES["inconsistent_groups"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", lower(trim(v)) AS canonical, string_agg(v, '|' ORDER BY v) AS spellings
    FROM (SELECT DISTINCT {c} AS v FROM ({MIXED[t]}) r) s GROUP BY lower(trim(v)) HAVING count(*) > 1"""
    for t, c in (("documents", "lang"), ("events", "event_type"))
)
ORACLES["duplicate_overlap_documents"] = f"""SELECT total, matched, shared_columns, overlap, total_reverse, matched_reverse, overlap_reverse
FROM ({problem(Suspicion("duplicate_entity", ("documents", "benchmark")))}) p"""
ORACLES["missing_keys"] = f"""SELECT "table" AS name, 'table' AS kind, rows FROM ({SIZES}) s WHERE "table" IN ({", ".join(lit(t) for t in [*TABLES, *DERIVED] if t not in PRIMARY)})"""
_KEYED = ", ".join(f"({lit(t)}, {lit(', '.join(PRIMARY.get(t, [])))}, {sum(f[0] == t for f in FOREIGN)})" for t in {*PRIMARY, "lineitem"})
ORACLES["keys_declared"] = f"""SELECT s."table", primary_key, n::BIGINT AS foreign_keys, rows FROM ({SIZES}) s LEFT JOIN (VALUES {_KEYED}) k("table", primary_key, n) USING ("table")"""


# ---- verdicts ----

ALL = f"SELECT claim_id, 'relationship' AS type, status, skipped, also_fits FROM ({measured(CLAIMS)}) a UNION ALL SELECT claim_id, 'suspicion', status, skipped, NULL FROM ({problems(SUSPICIONS)}) b"
ORACLES["verdict_summary"] = f"""SELECT type, CASE WHEN type = 'relationship' AND status = 'confirmed' AND also_fits > 0 THEN 'on weak evidence' ELSE status END AS status,
count(*) AS claims FROM ({ALL}) v GROUP BY 1, 2"""
ORACLES["empty_reasons"] = f"""
WITH r AS (SELECT skipped AS reason, count(*) AS claims FROM ({ALL}) v WHERE status = 'empty' GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY claims DESC, reason) AS rank FROM r)
SELECT rank::INT AS rank, reason, claims FROM k"""
ORACLES["broken_joins"] = f"SELECT row_number() OVER (ORDER BY hit, claim_id)::INT AS rank, claim_id, hit, orphans FROM ({measured(CLAIMS)}) v WHERE status = 'broken'"
ORACLES["has_findings"] = f"SELECT bool_or(CASE WHEN type = 'relationship' THEN status = 'broken' ELSE status = 'confirmed' END) AS has_findings FROM ({ALL}) v"
ORACLES["relation_kinds"] = f"SELECT 'table' AS kind, count(*) AS relations, 0::BIGINT AS partitioned, sum(rows)::BIGINT AS rows FROM ({SIZES}) s"


# ---- two runs ----


def lost(claim) -> str | None:
    """The name a kept claim uses that the later tables lack."""
    if isinstance(claim, Relationship):
        uses = [(claim.from_table, claim.from_column), (claim.to_table, claim.to_column)]
    else:
        uses = [(claim.tables[0], claim.column), *[(t, None) for t in claim.tables[1:]]]
    for table, column in uses:
        if table in GONE and GONE[table] is None:
            return table
        if column is not None and GONE.get(table) == column:
            return f"{table}.{column}"
    return None


_KEPT = ", ".join(f"({lit(c.claim_id)}, {lit(lost(c))})" for c in [*KEPT_CLAIMS, *KEPT_SUSPICIONS])


def both(env=None, gone=None) -> str:
    return (
        f"SELECT claim_id, status, hit, skipped FROM ({measured(KEPT_CLAIMS, env, gone)}) a"
        f" UNION ALL SELECT claim_id, status, NULL, skipped FROM ({problems(KEPT_SUSPICIONS, env, gone)}) b"
    )


CLASSES = "['regression', 'stale', 'drift', 'improved', 'changed', 'not measured', 'unchanged']"


def changes(env=None, gone=None, missing="missing") -> str:
    return f"""
WITH b AS ({both()}), a AS ({both(env, gone)}), k(claim_id, missing) AS (VALUES {_KEPT}),
j AS (SELECT claim_id, {missing} AS missing, b.status AS before, b.hit AS hit_before, a.status AS after, a.hit AS hit_after, a.skipped, claim_id LIKE 'relationship:%' AS r
  FROM k JOIN b USING (claim_id) JOIN a USING (claim_id))
SELECT claim_id, CASE WHEN missing IS NOT NULL THEN 'stale'
  WHEN before = after THEN CASE WHEN abs(hit_after - hit_before) > 0 AND abs(hit_after - hit_before) + 2.220446049250313e-16 >= 0.01 THEN 'drift' ELSE 'unchanged' END
  WHEN r AND (before, after) IN (('confirmed', 'broken'), ('confirmed', 'rejected'), ('broken', 'rejected')) THEN 'regression'
  WHEN NOT r AND before = 'rejected' AND after = 'confirmed' THEN 'regression'
  WHEN r AND before = 'broken' AND after = 'confirmed' THEN 'improved' WHEN NOT r AND before = 'confirmed' AND after = 'rejected' THEN 'improved'
  WHEN before = 'unverifiable' OR after = 'unverifiable' THEN 'not measured' ELSE 'changed' END AS class,
  before, hit_before, after, hit_after, skipped, missing FROM j"""


MOVED = changes(LATER, GONE)
TALLY = f"SELECT class FROM ({MOVED}) c UNION ALL SELECT 'stale' FROM range(2)"
ORACLES["remeasure_moved"] = MOVED
ORACLES["remeasure_unchanged"] = f"SELECT list_position({CLASSES}, class)::INT AS position, class, count(*) AS items FROM ({changes(missing='NULL')}) c GROUP BY class"
ORACLES["change_tally"] = f"SELECT list_position({CLASSES}, class)::INT AS position, class, count(*) AS items FROM ({TALLY}) c GROUP BY class"
ORACLES["gates"] = f"""
SELECT 'regression' AS fail_on, bool_or(class IN ('regression', 'stale')) AS fails FROM ({TALLY}) c
UNION ALL SELECT 'change', bool_or(class NOT IN ('not measured', 'unchanged')) FROM ({TALLY}) c UNION ALL SELECT 'never', false"""
SIDE = "{0} || coalesce(' ' || printf('%.1f', {1} * 100) || '%', '')"
ORACLES["change_rows"] = f"""
WITH items AS (SELECT class, 0 AS o, claim_id AS name, {SIDE.format("before", "hit_before")} AS before,
    CASE WHEN missing IS NOT NULL THEN missing || ' is not in the database' ELSE {SIDE.format("after", "hit_after")} END AS after,
    CASE WHEN missing IS NULL THEN skipped END AS reason FROM ({MOVED}) c WHERE class <> 'unchanged'
  UNION ALL SELECT 'stale', 1, 'labels', NULL, 'in the context, not in the database', NULL UNION ALL SELECT 'stale', 1, 'vip', NULL, 'in the database, not in the context', NULL),
ranked AS (SELECT *, row_number() OVER (ORDER BY list_position({CLASSES}, class), o, name) AS position FROM items)
SELECT position::INT AS position, class, name, before, after, reason FROM ranked"""
ORACLES["relations_moved"] = f"SELECT 'labels' AS name, 'before' AS found_in, count(*) AS rows FROM labels UNION ALL SELECT 'vip', 'now', count(*) FROM ({LATER_CUSTOMER}) v"


# ---- findings ----

_NAMES = {"row_count": "count", "age_days": "ageDays", "distinct_values": "distinctValues", "canonical_forms": "canonicalForms", "shared_columns": "sharedColumns",
          "total_reverse": "totalReverse", "matched_reverse": "matchedReverse", "overlap_reverse": "overlapReverse", "has_primary_key": "hasPrimaryKey"}
_ORDER = ["total", "exact", "row_count", "age_days", "distinct_values", "canonical_forms", "collisions", "matched", "shared_columns", "overlap", "total_reverse", "matched_reverse", "overlap_reverse", "has_primary_key"]
_NUMBERS = "concat_ws(', ', " + ", ".join(
    f"'{_NAMES.get(n, n)} ' || regexp_replace({n}::DECIMAL(38,18)::VARCHAR, '\\.?0+$', '')" for n in _ORDER
) + ")"
_TOLD = ", ".join(f"({lit(s.claim_id)}, {lit(t)}, {lit(', '.join([x for x in s.tables if x != t] + ([s.column] if s.column else [])))}, {lit(s.column)}, {lit(s.detail)}, {lit(s.tables[-1])})" for s in SUSPICIONS for t in dict.fromkeys(s.tables))
PROBLEM_LINES = f"""
SELECT claim_id, "table", status, CASE WHEN status = 'confirmed' THEN
  '**' || kind || CASE WHEN subject = '' THEN '' ELSE ' ' || subject END || '**: ' || {_NUMBERS}
  || CASE WHEN over IS NULL THEN '' WHEN overlap_reverse IS NOT NULL THEN ' (total, matched and overlap over ' || over || '; the Reverse ones over ' || other || ')' ELSE ' (measured over ' || over || ')' END || '.'
  || CASE WHEN kind = 'inconsistent_values' THEN ' Compare with lower(btrim(' || col || ')).' ELSE '' END
  || CASE WHEN kind = 'dead_table' AND age_days IS NOT NULL AND row_count <> 0 THEN ' No row is newer than ' || age_days
     || ' days: the table is unchanged, as a reference table is too; nothing here shows it unused.' ELSE '' END || ' ' || detail || ' (inferred)'
  ELSE kind || CASE WHEN subject = '' THEN '' ELSE ' ' || subject END || ' (inferred' || coalesce(', not measured: ' || skipped, '') || '): ' || detail END AS line
FROM ({problems(SUSPICIONS)}) p JOIN (VALUES {_TOLD}) t(claim_id, "table", subject, col, detail, other) USING (claim_id) WHERE status <> 'rejected'"""
ORACLES["problem_lines"] = PROBLEM_LINES

_PK = ", ".join(f"({lit(t)}, {lit(', '.join(PRIMARY.get(t, [])) or 'none')})" for t in COLUMNS)
ORACLES["table_reports"] = f"""
WITH facts AS (SELECT "table", 'table, ' || CASE WHEN rows = 0 THEN 'no rows' ELSE '~' || rows || ' rows' END || ', primary key: ' || pk AS line
  FROM ({SIZES}) s JOIN (VALUES {_PK}) k("table", pk) USING ("table")),
lines AS ({JOIN_LINES}),
each AS (SELECT from_table AS "table", claim_id, line FROM lines WHERE status <> 'rejected' UNION SELECT to_table, claim_id, line FROM lines WHERE status <> 'rejected'),
joins AS (SELECT "table", string_agg('- ' || line, chr(10) ORDER BY claim_id) AS text FROM each GROUP BY 1),
probs AS (SELECT "table", string_agg('- ' || line, chr(10) ORDER BY claim_id) AS text FROM ({PROBLEM_LINES}) p GROUP BY 1),
vals AS (SELECT "table", string_agg('- ' || "column" || ': ' || values, chr(10) ORDER BY "column") AS text FROM ({value_lists(item="to_json(v)::VARCHAR")}) v GROUP BY 1)
SELECT "table", '# ' || "table" || chr(10) || chr(10) || line || coalesce(chr(10) || chr(10) || '## Joins' || chr(10) || chr(10) || joins.text, '')
  || coalesce(chr(10) || chr(10) || '## Known problems' || chr(10) || chr(10) || probs.text, '')
  || coalesce(chr(10) || chr(10) || '## Values' || chr(10) || chr(10) || vals.text, '') || chr(10) AS report
FROM facts LEFT JOIN joins USING ("table") LEFT JOIN probs USING ("table") LEFT JOIN vals USING ("table")"""
