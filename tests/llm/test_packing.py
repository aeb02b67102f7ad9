import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.queries import tokenizer_files


def sequences(patterns):
    return sum(n for n, _ in patterns)


def check_patterns(patterns, counts, capacity):
    placed = Counter()
    for n, pattern in patterns:
        assert n > 0 and sum(x * k for x, k in pattern.items()) <= capacity
        for x, k in pattern.items():
            placed[x] += n * k
    assert placed == Counter(counts)


def fewest(items, capacity):
    @lru_cache(None)
    def go(left, rooms):
        if not left:
            return len(rooms)
        best = None
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in rooms[:i]:
                n = go(left[1:], tuple(sorted((*rooms[:i], r - left[0], *rooms[i + 1 :]))))
                best = n if best is None else min(best, n)
        n = go(left[1:], tuple(sorted((*rooms, capacity - left[0]))))
        return n if best is None else min(best, n)

    return go(tuple(sorted(items, reverse=True)), ())


def test_small_packings_are_the_fewest():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        counts = Counter(items)
        check_patterns(packing.best_fit(counts, capacity), counts, capacity)
        found = packing.complete(counts, capacity)
        check_patterns(found, counts, capacity)
        assert packing.least_sequences(counts, capacity) <= sequences(found) == fewest(items, capacity)


@pytest.mark.parametrize("sizes", [(1, 2048), (300, 1200), (600, 1100)])
def test_many_pieces(sizes):
    rng = random.Random(2)
    counts = Counter(rng.randint(*sizes) for _ in range(20_000))
    counts[2048] += 5
    found = packing.complete(counts, nodes=400)
    check_patterns(found, counts, 2048)
    assert sequences(found) <= sequences(packing.best_fit(counts))


def test_documents_are_packed_whole(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "Übung", "1234", "x\n", "niño", "<|endoftext|>"]) for _ in range(rng.choice([1, 40, 700, 4000]))) for _ in range(40)]
    texts += [None, "", texts[0], " " * 5000]
    docs = spark.createDataFrame([(t, i, 7, 8) for i, t in enumerate(texts)], "text string, doc_id int, length int, piece int")
    rows = packing.pack_documents(docs, *tokenizer_files()).collect()
    hf = Tokenizer.from_file(path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    ids = {i: [*hf.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen, filled = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == seen[r["doc_id"]] and (r["length"] == 2048 or r["piece"] == 0)
        seen[r["doc_id"]] += r["length"]
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == Counter({i: len(x) for i, x in ids.items()})
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) == packing.least_sequences(Counter(r["length"] for r in rows))


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, *tokenizer_files()).count() == 0
    same = spark.createDataFrame([(None, "a b")] * 50, "doc_id long, text string")
    rows = packing.pack(packing.pieces(same, *tokenizer_files()), rank_group_rows=7).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 50 and len({r["sequence_id"] for r in rows}) == 1


def test_queries_have_the_ids_of_the_library_as_it_comes(spark, tmp_path):
    import corpus_pipeline
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from plumbline.llm.queries import op7_best_fit_packing

    rng = random.Random(5)
    parts = ["the", "Übung", "\n", " ", "  ", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof", "text|>", "'s", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 40, 4000]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    hf = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: [*hf.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for found in (op7_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        seen = Counter()
        for r in found.collect():
            part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            seen[r["doc_id"]] += r["length"]
        assert seen == Counter({i: len(x) for i, x in ids.items()})
