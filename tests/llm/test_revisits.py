import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import revisits

SCHEMA = f"record_id long, url string, at long, kind string, etag string, last_modified string, headers {revisits.HEADERS}, part string"


def slow(rows):
    def key(url):
        return url and {"HTTP://A.com:80": "http://a.com/", "http://a.com#x": "http://a.com/", "http://a.com/": "http://a.com/"}.get(url, url)

    out = []
    for i, url, at, kind, etag, modified, headers, _ in rows:
        if kind != "revisit":
            continue
        old = [r for r in rows if r[3] == "response" and url and key(r[1]) == key(url) and None not in (at, r[2]) and (r[2], r[0]) < (at, i)]
        if not old:
            out.append((i, "no_earlier_response", None, None))
            continue
        r = max(old, key=lambda r: (r[2], r[0]))
        same = etag.removeprefix("W/") == r[4].removeprefix("W/") if etag and r[4] else modified == r[5] if modified and r[5] else None
        if not same:
            out.append((i, "no_validator" if same is None else "validator_mismatch", None, None))
            continue
        fresh = [(n.lower(), v) for n, v in headers or [] if n.lower() in revisits.PERMITTED]
        stored = [(n.lower(), v) for n, v in r[6] or [] if n.lower() not in {n for n, _ in fresh}]
        out.append((i, "resolved", r[0], tuple(sorted(stored + fresh))))
    return Counter(out)


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_equals_brute_force(spark, partitions):
    rng = random.Random(int(partitions))
    urls = ["http://a.com/", "http://a.com#x", "HTTP://A.com:80", "https://b.org/q?x=1", "odd", None]
    rows = []
    for i in range(400):
        url = rng.choice(urls[:3]) if rng.random() < 0.6 else rng.choice(urls)
        headers = [(n, rng.choice("uvw")) for n in rng.sample(["Date", "date", "ETag", "X-Other", "Content-Type"], rng.randint(0, 3))] or None
        at = rng.choice([None, *range(60)])
        rows.append((i, url, at, rng.choice(["response", "revisit", "revisit", "request"]), rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "m", "n"]), headers, "x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r["record_id"], r["status"], r["response_id"], None if r["headers"] is None else tuple(tuple(h) for h in r["headers"])) for r in got) == slow(rows)


def test_canonical_urls(spark):
    cases = {"HTTP://Me:x@Host.COM:80/a/?b=2&a=1#f": "http://host.com/a?a=1&b=2", "https://h:444": "https://h:444/", "https://h:443/x//": "https://h/x", "mailto:x": "mailto:x", "": "", None: None}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in rows} == cases


def test_empty_and_repeated(spark):
    rows = [(1, "u://h", 1, "response", "e", None, None, "x")] * 2 + [(2, "u://h", 2, "revisit", "e", None, None, "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["status"], r["response_id"]) for r in revisits.resolve(df).collect()] == [("resolved", 1)] * 2
    assert revisits.resolve(df.limit(0)).count() == 0
