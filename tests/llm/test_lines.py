import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import lines

SCHEMA = "n int, text string, doc_id long, words string, id string"


def slow(rows):
    key = lambda d: (1 << 63) - 1 if d is None else d
    sets = [(key(d), i, frozenset(re.split("[ \t\r\f\x0b]+", line.lower())) - {""}) for _, text, d, *_ in rows if text is not None for i, line in enumerate(text.split("\n"))]
    out = []
    for _, text, d, *_ in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        kept, all_ = [], text.split("\n")
        for i, line in enumerate(all_):
            s = frozenset(re.split("[ \t\r\f\x0b]+", line.lower())) - {""}
            if not (s and any((e, j) < (key(d), i) and 5 * len(s & o) >= 4 * len(s | o) for e, j, o in sets)):
                kept.append(line)
        out.append((d, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return Counter(out)


def corpus(rng, n):
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcé") for _ in range(4))
    base = [[word() for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 20, 60]))] for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 12)):
            line = list(rng.choice(base)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 15))]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if line:
                    line[rng.randrange(len(line))] = word()
            rng.shuffle(line)
            text.append(rng.choice([" ", "\t"]).join(line) + rng.choice(["", "\r", " "]))
        rows.append((1, "\n".join(text), rng.randint(0, n), "w", "i"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, 120)
    rows += [(0, None, 3, None, None), (0, "", 4, None, None), (0, "\n\n", 5, None, None), (0, "a b c d e", None, None, None), (0, "\n".join(f"line {i} {i * i}" for i in range(300)) * 2, 6, "", ""), rows[0], rows[1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lines.remove_similar_lines(docs, with_counts=True)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == slow(rows)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b\nb a\nc", 1, "", "")], SCHEMA)
    left = lines.remove_similar_lines(docs)
    assert [r["text"] for r in left.collect()] == ["a b\nc"]
    assert "Python" not in left._jdf.queryExecution().toString()
    assert lines.remove_similar_lines(docs.limit(0)).count() == 0


def test_near_copies_do_not_all_meet(spark, monkeypatch):
    """Each copy has rare words of its own, so no two have the same rarest words."""
    rows, n = [(1, " ".join(f"o{i}x{j}" if j in (i % 40, (7 * i + 3) % 40) else f"w{j}" for j in range(40)), i, "", "") for i in range(300)], {}

    def keep(df, name, real=lines.keep):
        out = real(df, name)
        n[name] = n.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "keep", keep)
    got = lines.remove_similar_lines(spark.createDataFrame(rows, SCHEMA), with_counts=True)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == slow(rows)
    assert n["candidates"] <= 10 * len(rows)


def test_large_sets_equal_brute_force(spark):
    """Of more words than there are cells of parities in a column, with similarities on both sides of the limit."""
    rng = random.Random(3)
    base = [[f"b{k}w{j}" for j in range(n)] for k, n in enumerate([85, 95, 96, 97, 110, 130])]
    rows = []
    for i in range(150):
        line = list(rng.choice(base))
        for j in range(rng.choice([0, 3, len(line) // 10, len(line) // 9, len(line) // 9 + 1, len(line) // 5])):
            line[rng.randrange(len(line))] = f"o{rng.randrange(400)}"
        rows.append((1, " ".join(line[: rng.choice([len(line), len(line) - 12])]), i, "", ""))
    got = lines.remove_similar_lines(spark.createDataFrame(rows, SCHEMA), with_counts=True)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == slow(rows)


def test_equal_lines_go_before_their_words_are_hashed(spark):
    docs = spark.createDataFrame([(1, "a b\nb a\nc", 1, "", "")], SCHEMA)
    plan = lines._sets(lines._lines(docs, "doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("transform(") < plan.index("Aggregate [k1")


def test_only_sets_that_may_be_marked_are_shuffled(spark):
    sets = spark.range(2000).withColumn("d", F.col("id"))
    got = lines._marked(sets, spark.range(0, 2000, 100))
    assert {r["id"] for r in got.collect() if r["similar"]} == set(range(0, 2000, 100)) and got.count() == 2000


def test_most_is_the_largest_size_that_leaves_the_overlap(spark):
    rows = spark.createDataFrame([(n, p) for n in range(1, 60) for p in range(n - -(-4 * n // 5) + 1)], "n int, p int")
    for r in rows.withColumn("most", F.expr(lines._most())).collect():
        assert r["most"] == max(m for m in range(200) if -(-4 * (r["n"] + m) // 9) <= r["n"] - r["p"])


def test_two_late_words_never_meet(spark):
    """Rows that the join by word shuffles and sorts are six numbers wide, and of two words one is early; still no similar pair is lost."""
    rng = random.Random(5)
    base = [f"b{j}" for j in range(60)]
    texts = [" ".join([f"o{i}x{j}" if rng.random() < 0.06 else w for j, w in enumerate(base)][: rng.randint(48, 60)]) for i in range(60)]
    found = lines._lines(spark.createDataFrame([(1, text, i // 2, "", "") for i, text in enumerate(texts)], SCHEMA), "doc_id", "text")
    sets = lines._sets(found).withColumn("similar", F.expr("id % 7 = 0")).localCheckpoint()
    early, late = lines._entries(sets)
    assert early.columns == late.columns == ["key", "all", "part", "id", "d", "size"]
    n_early, n_late = early.count(), late.count()
    assert 0 < n_early < n_early + n_late == sets.select(F.sum(F.size("prefix"))).first()[0] and n_late > 0.3 * n_early
    met = {tuple(r) for r in lines._meetings(early, early).unionByName(lines._meetings(early, late)).collect()}
    words = {r["id"]: (r["d"], frozenset(r["line"].split(" "))) for r in found.collect()}
    similar = {(a, b) for a, (d, x) in words.items() for b, (e, y) in words.items() if a != b and a % 7 and d >= e and 5 * len(x & y) >= 4 * len(x | y)}
    assert similar and all((a, b) in met or words[a][0] == words[b][0] and (b, a) in met for a, b in similar)
    assert all(a % 7 and words[a][0] >= words[b][0] for a, b in met)


def test_lines_of_one_document_are_told_apart_by_number(spark):
    """Both ways, and where one of the two has been found similar to yet another line."""
    rng = random.Random(6)
    rows = []
    for i in range(25):
        base = [[f"g{i}k{k}b{j}" for j in range(30)] for k in range(2)]
        line = lambda: " ".join(w if rng.random() > 0.06 else f"o{rng.random()}" for w in rng.choice(base)[: rng.randint(27, 30)])
        rows.append((1, "\n".join(line() for _ in range(rng.randint(3, 20))), i, "", ""))
    got = lines.remove_similar_lines(spark.createDataFrame(rows, SCHEMA), with_counts=True)
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == slow(rows)


@pytest.mark.parametrize("blank", lines.OTHER_BLANKS)
def test_other_blanks_are_found_without_a_pattern(spark, blank):
    blanks = lines._blanks_as_spaces(F.col("t"))
    rows = spark.createDataFrame([(f"a{blank}é{blank}{blank}b c",), ("a b",), ("",), (None,)], "t string").select(blanks.alias("t"))
    assert [r["t"] for r in rows.collect()] == ["a é  b c", "a b", "", None] and "RLIKE" not in rows._jdf.queryExecution().toString()
