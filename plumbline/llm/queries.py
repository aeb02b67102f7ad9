"""The registered query of each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import conversations, decontaminate, katz, language, lines, neardup, packing, periods, private, revisits, substrings, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=~held_out("doc_id", 4, 2))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def tokenizer_files() -> tuple[str, str]:
    """Ranks and word pattern of the public byte-level BPE with 50,257 ids. Its file for the tokenizers library has the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# The added token of that vocabulary's file for the tokenizers library, which finds it in any text.
SPECIAL_TOKENS = {"<|endoftext|>": 50256}


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(_table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"), train=~held_out("doc_id", 5, 0))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Each page as captures of one URL over time: a full response, and three revisits that write the URL in another way, one of them from
    before the response. Validators come from the page; every seventh page has changed them before its last revisit, every fifth has no
    entity tag."""
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    changed, untagged = page % 7 == 0, page % 5 == 0
    spelled = [F.col("url"), F.concat("url", F.lit("#again")), F.regexp_replace("url", "^http", "HTTP"), F.col("url")]

    def capture(n: int) -> Column:
        last = F.lit(n == 2)
        etag = F.when(~untagged, F.when(changed & last, F.lit('"new"')).otherwise(F.concat(F.lit("W/" * (n == 1)), tag)))
        modified = F.when(page % 10 != 0, F.when(changed & last, F.lit("changed")).otherwise(F.concat(F.lit("day "), F.pmod(page, F.lit(28)).cast("string"))))
        fields = [("Date", F.concat(F.lit(f"at {n} of "), page.cast("string"))), ("Content-Type" if n == 0 else "X-Cache", F.lit("text/html" if n == 0 else "hit")), ("ETag", etag)]
        headers = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in fields])
        when = page * 10 + (-1 if n == 3 else n)
        return F.struct(
            (page * 4 + n).alias("record_id"), spelled[n].alias("url"), when.alias("at"), F.lit(revisits.REVISIT if n else revisits.RESPONSE).alias("kind"),
            etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"),
        )

    return pages.select(F.explode(F.array(*[capture(n) for n in range(4)])).alias("c")).select("c.*")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures_of_pages(_table(spark, sf_dir, "pages")))
    written = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), F.coalesce(h["value"], F.lit("")))), ";")
    return found.select("record_id", "canonical", F.col("at").alias("captured_at"), "status", "response_id", written.alias("merged_headers"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.remove_similar_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_counts=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer_files(), special=SPECIAL_TOKENS)


def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the plain spans, spans is of all."""
    found = private.find_identifiers(_table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in private.KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long")
    return found.select("doc_id", *counts, F.sha2(written(plain), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added.alias("n_disguised"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text, every tenth with a stretch of words repeated to its end, as the id's checksum says."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, h = F.size(words), F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    at = (g % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - at) / period).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, at + 1, period), turns)), F.lit(1), n - at)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), at), repeated), " ")
    return F.when((h % 10 == 0) & text.isNotNull() & (n > 0), planted).otherwise(text).alias("text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")))
    found = periods.find_runs(docs)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    fullest = F.aggregate("runs", none, lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
    told = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    lines = F.array_join(F.transform(told, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", fullest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.score(_table(spark, sf_dir, "documents"), train=~held_out("doc_id", 7, 2))
    return found.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns with faults, one in five by the checksum of its place: gone, emptied, without its sentence ends, told twice, given to the user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"))
    rows = rows.withColumn("fault", F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = conversations.whole(conversations.repair(damaged_turns(turns))).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return every.select("conv_id", *counts, text("audit").alias("audit"), F.sha2(text("repaired_text"), 256).alias("repaired_sha256"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pii_deobfuscation": op8_pii_deobfuscation,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_katz_scoring": op12_katz_scoring,
    "op13_conversation_repair": op13_conversation_repair,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_line_dedup": r"""
        WITH a AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
        ), l AS (
            SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS line FROM a
        ), w AS (
            SELECT doc_id, text, ln, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\r\f\x0B]+'), lambda x: x <> ''))) AS s FROM l
        ), f AS (
            SELECT s, min(doc_id * 1000000 + ln) AS o FROM w WHERE len(s) > 0 GROUP BY s
        ), e AS (
            SELECT s, o, len(s) AS n, unnest(s) AS t FROM f
        ), c AS (
            SELECT t, count(*) AS c FROM e GROUP BY t
        ), p AS (
            SELECT e.s, e.o, e.n, e.t, row_number() OVER (PARTITION BY e.o ORDER BY c.c, e.t) AS k FROM e JOIN c ON c.t = e.t
        ), q AS (
            SELECT * FROM p WHERE k <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1
        ), m AS (
            SELECT DISTINCT x.o, x.s AS xs, y.s AS ys FROM q AS x JOIN q AS y ON x.t = y.t AND x.o > y.o AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
        ), r AS (
            SELECT DISTINCT o FROM m WHERE 5 * len(list_intersect(xs, ys)) >= 4 * (len(xs) + len(ys) - len(list_intersect(xs, ys)))
        ), g AS (
            SELECT w.doc_id, w.text, w.ln, w.line, f.o IS NOT NULL AND (f.o <> w.doc_id * 1000000 + w.ln OR r.o IS NOT NULL) AS gone
            FROM w LEFT JOIN f ON f.s = w.s LEFT JOIN r ON r.o = f.o
        ), d AS (
            SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
                sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY ln), '')) AS kept_sha256
            FROM g GROUP BY doc_id
        )
        SELECT a.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256 FROM a LEFT JOIN d ON d.doc_id = a.doc_id
    """,
    "op1_exact_topk": """
        WITH c AS (
            SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL
        ), bad AS (
            SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR isnan(x) OR isinf(x)
        ), v AS (
            SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.i = v.i WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id GROUP BY 1, 2
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op4_warc_revisits": r"""
        WITH p AS (
            SELECT page_id, url, '"' || md5(html) || '"' AS tag, n FROM pages CROSS JOIN (SELECT unnest(range(0, 4)) AS n) AS t
        ), raw AS (
            SELECT page_id * 4 + n AS record_id, page_id * 10 + CASE WHEN n = 3 THEN -1 ELSE n END AS captured_at, n, page_id,
                CASE n WHEN 1 THEN url || '#again' WHEN 2 THEN regexp_replace(url, '^http', 'HTTP') ELSE url END AS url,
                CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 AND n = 2 THEN '"new"' WHEN n = 1 THEN 'W/' || tag ELSE tag END AS etag,
                CASE WHEN page_id % 10 = 0 THEN NULL WHEN page_id % 7 = 0 AND n = 2 THEN 'changed' ELSE 'day ' || CAST(page_id % 28 AS VARCHAR) END AS last_modified,
                'at ' || CAST(n AS VARCHAR) || ' of ' || CAST(page_id AS VARCHAR) AS date
            FROM p
        ), parts AS (
            SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#:]+)([^?#]*)(\?([^#]*))?', 1)) AS scheme,
                lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#:]+)([^?#]*)(\?([^#]*))?', 2)) AS host,
                regexp_replace(regexp_extract(url, '^([A-Za-z]+)://([^/?#:]+)([^?#]*)(\?([^#]*))?', 3), '/+$', '') AS path,
                regexp_extract(url, '^([A-Za-z]+)://([^/?#:]+)([^?#]*)(\?([^#]*))?', 5) AS query
            FROM raw
        ), c AS (
            SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
                || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical
            FROM parts
        ), j AS (
            SELECT v.*, r.record_id AS rid, r.etag AS r_etag, r.last_modified AS r_modified, r.page_id AS r_page,
                row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured_at DESC, r.record_id DESC) AS k
            FROM c AS v LEFT JOIN c AS r ON r.n = 0 AND r.canonical = v.canonical AND (r.captured_at < v.captured_at OR r.captured_at = v.captured_at AND r.record_id < v.record_id)
            WHERE v.n > 0
        ), s AS (
            SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', ''), last_modified = r_modified) AS same FROM j WHERE k = 1
        )
        SELECT record_id, canonical, captured_at,
            CASE WHEN rid IS NULL THEN 'no_earlier_response' WHEN same THEN 'resolved' WHEN same IS NULL THEN 'no_validator' ELSE 'validator_mismatch' END AS status,
            CASE WHEN same THEN rid END AS response_id,
            CASE WHEN same THEN 'content-type=text/html;date=' || date || ';etag=' || coalesce(etag, '') END AS merged_headers
        FROM s
    """,
    "op3_decontamination": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), i AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark
        ), iw AS (
            SELECT DISTINCT item, least(13, len(v)) AS n, array_to_string(v[k : k + least(13, len(v)) - 1], ' ') AS s
            FROM (SELECT item, v, unnest(range(1, greatest(1, len(v) - 12) + 1)) AS k FROM i WHERE len(v) > 0) AS t
        ), ns AS (
            SELECT DISTINCT n FROM iw
        ), dw AS (
            SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN ns WHERE len(w) >= n) AS t
        ), m AS (
            SELECT dw.r, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s
        ), h AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) AS t GROUP BY r
        ), g AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) AS t GROUP BY r
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN g ON g.r = d.r
    """,
}
