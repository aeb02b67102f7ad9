"""The registered queries over the smallest tables, where SQL says nothing about them."""

import hashlib

from plumbline.llm import queries
from test_private import slow as slow_spans
from test_substrings import slow as slow_repeats

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_substrings(spark):
    docs = documents(spark)
    want = dict(zip(docs, slow_repeats(list(docs.values()), 35)))
    got = queries.op5_substring_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {d: w[:3] for d, w in want.items()}


def test_identifiers(spark):
    docs = documents(spark)
    for r in queries.op8_pii_deobfuscation(spark, SF).collect():
        spans = slow_spans(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        base = ",".join(":".join(map(str, s)) for s in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(","))


def test_every_query_names_its_columns(spark):
    wanted = {
        "op1": ["query_id", "rank", "vec_id", "score"], "op2": ["doc_id", "held_out", "lang_pred", "score"],
        "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op5": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op7": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op8": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op9": ["doc_id", "fingerprint", "component_id"],
        "op10": ["doc_id", "held_out", "score", "predicted"],
        "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        "op12": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op13": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    }
    for name, query in queries.QUERIES.items():
        columns = query(spark, SF).columns
        assert columns[: len(wanted.get(name.split("_")[0], []))] == wanted.get(name.split("_")[0], []), name
