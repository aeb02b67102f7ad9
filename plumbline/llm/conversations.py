"""Repairing the structure of conversations by generalised LR parsing with edits.

The roles of a conversation are read by an LR automaton of the role grammar. Besides keeping a turn there are weighted edits: delete it, give it
another role, insert a turn. All parses are followed together on a graph-structured stack: a node is an LR state at a place of the input, an
edge goes to the node below and carries the cheapest (cost, edits) made since, the edits as initials. Where two parses reach the same stack top
over equal stacks they are merged by the lesser pair, so a node has an edge for each stack that can be below it and no more. Of two edit strings over the same turns at the same cost neither begins the other, since
what is left over could only be insertions, which cost; so the lesser string stays the lesser whatever follows, and merging loses nothing.

Turns are dealt by ranges of (conversation, turn), so a long conversation is spread over several tasks. What lies whole in one task is parsed
there. Of the others each segment is parsed from every stack that the grammar allows between turns, and the segments of a conversation are then
joined by their stacks, without their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_TURNS = 1024
REMEMBERED = 1 << 15
REMEMBERED_TURNS = 32

WHITE = "\t\n\x0b\x0c\r "
ROLES = {"u": "user", "a": "assistant"}  # what turns may be given or inserted as
# (s?(ua)+)?, left-recursive, so that only a few stacks can stand between two turns
RULES = (("<S>", ()), ("<S>", ("<T>",)), ("<T>", ("<P>",)), ("<T>", ("s", "<P>")), ("<P>", ("u", "a")), ("<P>", ("<P>", "u", "a")))

Weight = tuple[int, str]
Stack = tuple[int, ...]
Turn = tuple[str, str, int]  # initial of the role; fault: "", "truncated" or "delete"; further copies to delete


class Automaton:
    """The LR(0) automaton of a grammar whose nonterminals are written <X>, the first rule's being the start."""

    def __init__(self, rules: tuple = RULES):
        self.start = rules[0][0]
        rules = (("<>", (self.start,)), *rules)
        self.goto: dict[tuple[int, str], int] = {}
        self.symbol: list[str] = [""]  # over which a state is entered
        states = [self._closure({(0, 0)}, rules)]
        for i, state in enumerate(states):  # grows meanwhile
            for symbol in sorted({rules[r][1][dot] for r, dot in state if dot < len(rules[r][1])}):
                after = self._closure({(r, dot + 1) for r, dot in state if rules[r][1][dot : dot + 1] == (symbol,)}, rules)
                if after not in states:
                    states.append(after)
                    self.symbol.append(symbol)
                self.goto[i, symbol] = states.index(after)
        self.reduces = [[(rules[r][0], dot) for r, dot in sorted(state) if dot == len(rules[r][1])] for state in states]
        self.shifts = [any(q == i and s[0] != "<" for q, s in self.goto) for i in range(len(states))]
        self.stacks = self._between()

    @staticmethod
    def _closure(items: set, rules: tuple) -> frozenset:
        todo = list(items)
        while todo:
            r, dot = todo.pop()
            for i, (left, _) in enumerate(rules):
                if rules[r][1][dot : dot + 1] == (left,) and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _between(self) -> list[Stack]:
        """The stacks that can stand between two turns."""
        found, terminals = [(0,)], {s for _, s in self.goto if s[0] != "<"}
        for stack in found:
            for t in sorted(terminals):
                for after in self.parse(stack, ((t, "", 0),), edits=False):
                    if after not in found:
                        found.append(after)
        return found

    # ---- the graph-structured stack ----

    def close(self, front: dict[int, Node], edits: bool = True) -> None:
        """Reductions and insertions until nothing gets cheaper."""
        changed = True
        while changed:
            changed = False
            for node in list(front.values()):
                for left, n in self.reduces[node.state]:
                    for base, weight in list(node.paths(n)):
                        to = self.goto.get((base.state, left))
                        changed |= to is not None and _add(front, to, base, weight)
                if edits:
                    for t in ROLES:
                        to = self.goto.get((node.state, t))
                        changed |= to is not None and _add(front, to, node, (INSERT, "I"))
        _merged_tops(front)

    def step(self, front: dict[int, Node], turn: Turn, edits: bool = True) -> dict[int, Node]:
        """The stacks after one turn and its further copies."""
        initial, fault, copies = turn
        after: dict[int, Node] = {}
        if fault != "delete":
            self.close(front, edits)
            more = TRUNCATED if fault else 0
            for node in front.values():
                if not self.shifts[node.state]:  # goes on as what it reduces to
                    continue
                to = self.goto.get((node.state, initial))
                if to is not None and initial[:1] != "<":
                    _add(after, to, node, (KEEP + more, "K"))
                if edits:
                    for t in ROLES:
                        to = self.goto.get((node.state, t))
                        if to is not None:
                            _add(after, to, node, (REROLE + more, "R"))
                    for below, (cost, made) in node.edges.items():
                        _add(after, node.state, below, (cost + DELETE, made + "D"))
            front, after = _merged_tops(after), {}
        else:
            copies += 1
        if not copies:
            return front
        # An insertion sorts after a deletion, so none is tried between copies.
        for node in front.values():
            for below, (cost, made) in node.edges.items():
                _add(after, node.state, below, (cost + DELETE * copies, made + "D" * copies))
        return _merged_tops(after)

    def parse(self, stack: Stack, turns: tuple[Turn, ...], edits: bool = True) -> dict[Stack, Weight]:
        """The cheapest edits that lead from one stack to each other over some turns."""
        node = None
        for state in stack:
            node = Node(state, {node: (0, "")})
        front = {node.state: node}
        for turn in turns:
            front = self.step(front, turn, edits)
        self.close(front, edits)
        out: dict[Stack, Weight] = {}
        for top in front.values():
            if self.shifts[top.state]:
                for states, weight in top.whole().items():
                    if states not in out or weight < out[states]:
                        out[states] = weight
        return out

    def accepts(self, stack: Stack) -> bool:
        """Whether a conversation may end here."""
        node = None
        for state in stack:
            node = Node(state, {node: (0, "")})
        front = {node.state: node}
        self.close(front, edits=False)
        return self.goto[0, self.start] in front

    def expected(self, stack: Stack) -> str:
        """The role that a given or inserted turn has first after this stack."""
        return next(t for t in ROLES if (stack[-1], t) in self.goto)


class Node:
    """An LR state at a place of the input, with the nodes below and what was done since."""

    __slots__ = ("state", "edges", "known")

    def __init__(self, state: int, edges: dict[Node | None, Weight]):
        self.state, self.edges, self.known = state, edges, None

    def paths(self, n: int) -> Iterator[tuple[Node, Weight]]:
        if n == 0:
            yield self, (0, "")
            return
        for below, (cost, made) in self.edges.items():
            if below is not None:
                for base, (c, m) in below.paths(n - 1):
                    yield base, (c + cost, m + made)

    def whole(self) -> dict[Stack, Weight]:
        """The stacks that end here with the cheapest edits of each. To be asked once the place is done with."""
        if self.known is None:
            self.known = {}
            for below, (cost, made) in self.edges.items():
                for states, (c, m) in [((), (0, ""))] if below is None else below.whole().items():
                    stack, weight = (*states, self.state), (c + cost, m + made)
                    if stack not in self.known or weight < self.known[stack]:
                        self.known[stack] = weight
        return self.known


def _merged_tops(front: dict[int, Node]) -> dict[int, Node]:
    """Of edges to nodes with the same stack below, only the cheapest from the bottom up; the nodes below are done with."""
    for node in front.values():
        best: dict[Stack, tuple[Weight, Node | None]] = {}
        for below, (cost, made) in node.edges.items():
            for states, (c, m) in [((), (0, ""))] if below is None else below.whole().items():
                weight = (c + cost, m + made)
                if states not in best or weight < best[states][0]:
                    best[states] = weight, below
        node.edges = {below: node.edges[below] for _, below in best.values()}
    return front


def _add(front: dict[int, Node], state: int, below: Node | None, weight: Weight) -> bool:
    """Merges into the node of that state; whether this is new or cheaper."""
    node = front.get(state)
    if node is None:
        node = front[state] = Node(state, {})
    if below in node.edges and node.edges[below] <= weight:
        return False
    node.edges[below] = weight
    return True


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(REMEMBERED)
def _remembered(entry: int, turns: tuple[Turn, ...]) -> tuple:
    return _transfers(entry, turns)


def _transfers(entry: int, turns: tuple[Turn, ...]) -> tuple:
    lr = automaton()
    return tuple((entry, lr.stacks.index(stack), *weight) for stack, weight in sorted(lr.parse(lr.stacks[entry], turns).items()))


def transfers(entry: int, turns: tuple[Turn, ...]) -> tuple:
    """(entry, exit, cost, edits) over some turns, stacks by their number in Automaton.stacks."""
    return _remembered(entry, turns) if len(turns) <= REMEMBERED_TURNS else _transfers(entry, turns)


def joined(segments: list[tuple]) -> list[tuple]:
    """Of the transfers of a conversation's segments in order, the one of each that together are cheapest."""
    lr = automaton()
    best: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}
    for some in segments:
        after: dict[int, tuple[int, str, tuple | None]] = {}
        for t in some:
            if t[0] in best:
                cost, made, path = best[t[0]]
                now = (cost + t[2], made + t[3], (path, t))
                if t[1] not in after or now[:2] < after[t[1]][:2]:
                    after[t[1]] = now
        best = after
    path, out = min((x for stack, x in best.items() if lr.accepts(lr.stacks[stack])), key=lambda x: x[:2])[2], []
    while path is not None:
        path, t = path
        out.append(t)
    return out[::-1]


def applied(turns: list[tuple[str, str, int]], edits: str, expected: str) -> list[dict]:
    """The turns, each with its role, text and number of copies, after the edits."""
    out: list[dict] = []

    def put(role: str, text: str) -> None:
        nonlocal expected
        out.append({"role": role, "text": text})
        expected = "a" if role[:1] == "u" else "u"

    each = (x for role, text, copies in turns for x in [(role, text)] * copies)
    for edit in edits:
        if edit == "I":
            put(ROLES[expected], "")
            continue
        role, text = next(each)
        if edit == "K":
            put(role, text)
        elif edit == "R":
            put(ROLES[expected], text)
    return out


# ---- tables ----

_TRANSFER = "array<struct<entry:int,exit:int,cost:bigint,edits:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SEGMENT = (
    "part int, seq bigint, whole boolean, transfers " + _TRANSFER + ", " + ", ".join(f"{c} bigint" for c in _COUNTS)
    + ", first_role string, last_role string, low bigint, high bigint, numbers bigint, turns array<struct<role:string,text:string,copies:bigint>>"
)
REPAIRED = "array<struct<role:string,text:string>>"
LEGAL = ("su", "ua", "au")


def _segment(turns: list[tuple], starts: bool, ends: bool) -> dict:
    """turns: (turn, role, text, copies, blank, repeated, truncated), in order, of one conversation."""
    count = dict.fromkeys(_COUNTS, 0)
    read, numbers, before = [], [], None
    for number, role, _, copies, blank, repeated, truncated in turns:
        initial = role[:1]
        fault = "delete" if blank or repeated else "truncated" if truncated else ""
        again = copies - 1
        if blank:
            count["blank"] += copies
        else:
            count["duplicate"] += copies if repeated else again
            count["truncated"] += fault == "truncated"
        if before is not None:
            count["illegal"] += before + initial not in LEGAL
        count["illegal"] += again * (initial + initial not in LEGAL)
        before = initial
        read.append((initial, fault, again))
        if number is not None and (not numbers or numbers[-1] != number):
            numbers.append(number)
    entries = [0] if starts else range(len(automaton().stacks))
    found = [t for entry in entries for t in transfers(entry, tuple(read))]
    if starts and ends:
        found = joined([found])
    return count | {
        "whole": starts and ends, "transfers": [dict(zip(("entry", "exit", "cost", "edits"), t, strict=True)) for t in found],
        "first_role": turns[0][1][:1], "last_role": before, "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None,
        "numbers": len(numbers), "turns": [{"role": r, "text": t, "copies": n} for _, r, t, n, *_ in turns],
    }


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cuts a task's turns, in order, into segments of one conversation each."""
    part, rows, held = TaskContext.get().partitionId(), [], []
    here, seq, starts = object(), 0, False  # the first conversation may have begun in the task before

    def cut(ends: bool) -> None:
        nonlocal held, seq
        if held:
            rows.append({"id": here, "part": part, "seq": seq} | _segment(held, starts, ends))
            held, seq = [], seq + 1

    first = part == 0
    for batch in slices(batches):
        for conv, *turn in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if conv != here or type(conv) is not type(here):
                cut(True)
                here, starts, first = conv, first or seq > 0, False
            elif len(held) == SEGMENT_TURNS:
                cut(False)
                starts = False
            held.append(turn)
        if len(rows) >= 64:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    cut(False)
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _merged(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Of one conversation's segments, without texts: the edits of each, and counts that see over their ends."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    chosen = joined([[tuple(t.values()) for t in r["transfers"]] for r in rows])
    out, before, high = [], None, None
    for r, t in zip(rows, chosen, strict=True):
        numbers = r["numbers"] - (r["low"] is not None and r["low"] == high)
        out.append({"part": r["part"], "seq": r["seq"], "chosen": dict(zip(("entry", "exit", "cost", "edits"), t, strict=True)), "numbers": numbers, "illegal": r["illegal"] + (before is not None and before + r["first_role"] not in LEGAL)})
        before, high = r["last_role"], r["high"] if r["high"] is not None else high
    return pa.Table.from_pylist(out, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lr = automaton()
    for batch in slices(batches, 64):
        rows = [applied([tuple(t.values()) for t in r["turns"]], r["edits"], lr.expected(lr.stacks[r["entry"]])) for r in batch.to_pylist()]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        rest = [i for i, name in enumerate(batch.schema.names) if name not in ("turns", "entry")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(rows, kind)], [*(batch.schema.names[i] for i in rest), "repaired"])


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each segment of a conversation, most conversations being one: conversation, part, seq (their order), cost, edits, repaired (array of
    role, text), and what whole() sums: blank, duplicate, truncated, illegal, low, high, numbers.

    Turns are read by number, nulls first, those of one number by role and then by a hash of the text. A null role or text counts as one space. A
    turn's first fault counts: blank (only white space), duplicate (role and text of an earlier turn of the conversation), truncated (its last
    visible character is none of . ! ?). Blank and duplicate turns are deleted; other edits are found as the module says. Copies of one row are
    counted before anything is shuffled by conversation, and are duplicates of each other. A null conversation is one too; an empty table
    gives no rows; other columns are not read. A turn's text is held whole, and a segment of at most SEGMENT_TURNS different turns. The edits
    of a long conversation, not its texts, are joined by one task: they are one value of the result as well.
    """
    cell = lambda c: F.col(f"`{c}`")
    kind = turns.select(cell(conversation).alias("id")).schema["id"].dataType.simpleString()
    told = [F.coalesce(cell(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    rows = turns.select(cell(conversation).alias("id"), cell(turn).cast("bigint").alias("turn"), *told)
    rows = rows.withColumns({f"k{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)})
    distinct = rows.groupBy("id", "turn", "k1", "k2").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # Where role and text stand at several numbers of a conversation, the first of them, null before all others.
    stands = rows.select("id", "k1", "k2", "turn").distinct().groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.count("turn").alias("told"), F.min("turn").alias("least"))
    several = stands.where("n > 1").select(F.col("id").alias("i"), F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.when(F.col("told") == F.col("n"), F.col("least")).alias("at"), F.lit(True).alias("more"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))
    seen = F.coalesce(F.col("more"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("at"))
    end = F.right(_trimmed(F.col("text")), F.lit(1))
    judged = distinct.join(several, same, "left").select(
        "id", "turn", "role", "text", "copies", (_trimmed(F.col("text")) == "").alias("blank"), seen.alias("repeated"), (~end.isin(".", "!", "?")).alias("truncated"), "k1", "k2"
    )
    order = ["id", F.col("turn").asc_nulls_first(), "role", "k1", "k2"]
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order).drop("k1", "k2")

    spec = f"id {kind}, {_SEGMENT}"
    arrow = _arrow(turns.sparkSession, spec)
    segments = keep(ranged.mapInArrow(lambda batches: _segments(batches, arrow), spec), "segments")
    merged = "part int, seq bigint, chosen struct<entry:int,exit:int,cost:bigint,edits:string>, numbers bigint, illegal bigint"
    m = _arrow(turns.sparkSession, merged)
    parts = segments.where("NOT whole").drop("turns").groupBy("id").applyInArrow(lambda table: _merged(table, m), merged)
    out = ["id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "low", "high", "numbers", "chosen.entry", "chosen.cost", "chosen.edits", "turns"]
    alone = segments.where("whole").withColumn("chosen", F.col("transfers")[0]).select(*out)
    spread = segments.where("NOT whole").drop("numbers", "illegal").join(parts, ["part", "seq"]).select(*out)
    done = alone.unionByName(spread).mapInArrow(_apply, f"id {kind}, part int, seq bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, numbers bigint, cost bigint, edits string, repaired {REPAIRED}")
    return done.withColumnRenamed("id", conversation)


def whole(segments: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """A row for each conversation of repair(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_text (role:text lines)."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "edits", F.array_join(lines, "\n").alias("lines"), (F.size("repaired") > 0).alias("any"))))
    counts = [F.sum(c).alias(c) for c in (*_COUNTS, "cost")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("numbers"), F.lit(0).cast("bigint")).alias("gaps")
    one = segments.groupBy(F.col(f"`{conversation}`")).agg(gaps, *counts, parts.alias("parts"))
    kept = F.transform(F.filter("parts", lambda p: p["any"]), lambda p: p["lines"])
    return one.select(F.col(f"`{conversation}`"), "gaps", *_COUNTS, "cost", F.array_join(F.transform("parts", lambda p: p["edits"]), "").alias("audit"), F.array_join(kept, "\n").alias("repaired_text"))


def _arrow(spark, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))
