import random
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from plumbline.llm import conversations as conv
from plumbline.llm import queries

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def faults(turns: list[tuple]) -> list[str]:
    seen, out = set(), []
    for role, text in turns:
        stripped = text.rstrip("\t\n\x0b\x0c\r ")
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else "" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def slow(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """The cheapest edits by trying all of them from the right, at most three insertions in a row."""
    fault = faults(turns)

    @lru_cache(None)
    def best(i: int, last: str, inserted: int) -> tuple:
        ways = [(0, "")] if i == len(turns) and last in ("", "a") else []

        def way(cost: int, edit: str, to: tuple) -> None:
            rest = best(*to)
            if rest:
                ways.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            for t in "ua":
                if (last, t) in NEXT:
                    way(3, "I", (i, t, inserted + 1))
        if i < len(turns):
            way(4, "D", (i + 1, last, 0))
            if fault[i] in ("", "truncated"):
                more = 3 if fault[i] else 0
                if (last, turns[i][0][:1]) in NEXT:
                    way(more, "K", (i + 1, turns[i][0][:1], 0))
                for t in "ua":
                    if (last, t) in NEXT:
                        way(3 + more, "R", (i + 1, t, 0))
        return min(ways, default=())

    return best(0, "", 0)


def slow_repaired(turns: list[tuple], audit: str) -> list[tuple]:
    out, rows = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            given = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((role if edit == "K" else given, text))
    return out


def slow_row(numbered: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text of turns in order."""
    turns = [t[1:] for t in numbered]
    numbers = {t[0] for t in numbered} - {None}
    f, initials = faults(turns), [t[0][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = slow(turns) if turns else (0, "")
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in slow_repaired(turns, audit))


def some_turns(rng: random.Random, n: int) -> list[tuple]:
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " ", "<S>"]
    return [(rng.choice(roles), rng.choice(["Yes.", "no", "", " \n", "Why? ", "ok!", "a b c"])) for _ in range(n)]


def read(turns: list[tuple]) -> tuple:
    return tuple((t[0][:1], "delete" if f in ("blank", "duplicate") else f, 0) for t, f in zip(turns, faults(turns)))


def test_cheapest_edits():
    rng, lr = random.Random(3), conv.automaton()
    for _ in range(1500):
        turns = some_turns(rng, rng.randint(0, 9))
        found = conv.joined([conv.transfers(0, read(turns))])
        assert [t[2:] for t in found] == [slow(turns)], turns
    assert len(lr.stacks) == 8


def test_segments_join_to_the_whole():
    rng, every = random.Random(4), range(len(conv.automaton().stacks))
    for _ in range(150):
        turns = some_turns(rng, rng.randint(2, 12))
        r, cut = read(turns), rng.randint(1, len(turns) - 1)
        parts = [conv.transfers(0, r[:cut]), [t for e in every for t in conv.transfers(e, r[cut:])]]
        found = conv.joined(parts)
        assert (sum(t[2] for t in found), "".join(t[3] for t in found)) == slow(turns)


def rows_of(spark, rows, names="conv_id long, turn long, role string, text string"):
    return spark.createDataFrame(rows, names)


def result(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in conv.whole(conv.repair(frame)).collect()}


@pytest.mark.parametrize("length", [1024, 3])
def test_tables(spark, monkeypatch, length):
    monkeypatch.setattr(conv, "SEGMENT_TURNS", length)
    rng, rows = random.Random(length), []
    for c in [None, *range(12)]:
        n = 60 if c == 5 else rng.randint(1, 8)
        rows += [(c, i if rng.random() < 0.9 else None, *t) for i, t in zip(sorted(rng.sample(range(3 * n), n)), some_turns(rng, n))]
        rows += rng.sample(rows, 1) if rng.random() < 0.5 else []
    rows += [(3, 1, None, None), (3, 1, "user", None)]
    got = result(rows_of(spark, rows))
    hashes = {(r["role"], r["text"]): (r["a"], r["b"]) for r in rows_of(spark, rows).selectExpr("coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text").selectExpr("*", "xxhash64(1, role, text) AS a", "xxhash64(2, role, text) AS b").collect()}
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(t, r or " " if r is None else r, " " if x is None else x) for d, t, r, x in rows if d == c]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashes[t[1:]]))
        want[c] = slow_row(turns)
    assert got == want


def test_copies_of_a_turn(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")] + [(1, 1, "assistant", "Yes.")] * 5000
    assert result(rows_of(spark, rows)) == {1: (0, 0, 5000, 0, 5000, 20000, "KK" + "D" * 5000, "user:Hi.\nassistant:Yes.")}


def test_empty_and_extra_columns(spark):
    frame = rows_of(spark, [(1, 0, "user", "Hi.")])
    assert result(frame.where("false")) == {}
    named = frame.selectExpr("conv_id AS `a.b`", "turn", "role", "text", "1 AS id", "2 AS part", "3 AS seq", "4 AS blank")
    assert [r["repaired"] for r in conv.repair(named, "a.b").collect()] == [[("user", "Hi."), ("assistant", "")]]


def test_query_against_all_edits(spark):
    sf, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn", "role").collect():
        turns, fault = want.setdefault(r["conv_id"], []), zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if fault == 1 else "".join(c for c in r["text"] if c not in ".!?") if fault == 2 else r["text"]
        turns += [(r["turn"], "user" if fault == 4 else r["role"], text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()}
    rows = {c: slow_row(t) for c, t in want.items()}
    assert got == {c: (*r[:7], sha256(r[7].encode()).hexdigest()) for c, r in rows.items()}
    assert sum(r[5] for r in rows.values()) > 0
