"""Removing lines that are nearly equal to an earlier line, by an exact set-similarity join in DataFrame functions alone.

Equal lines collapse to their first. The words of the others are ordered by rarity: by the level of the count of their hash's cell in a table
of 2 ** CELL_BITS cells over all lines, whose size no corpus changes; then by hash. Two sets with Jaccard similarity
t share a word among the first few of either; for sizes a and b they need overlap o = ceil(t / (1 + t) * (a + b)), so it is among the first
a - o + 1 and b - o + 1. A set meets first the MET_BEFORE ones that come next before it among those with one of MET_WORDS of its rare words,
and is compared with the one that seems nearest. Most lines of a large group of near copies are decided by that, one pair each, and only the
others meet all sets that share a word. The parities of a set's words in 128 cells bound the overlap before words are compared. Words are
told apart by 64 bits of hash.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import forget, keep

SIMILARITY = (4, 5)  # numerator and denominator
CELL_BITS = 20
LEVEL_BITS, LEVELS_PER_DOUBLING = 7, 4
HASH_MASK = (1 << 63 - LEVEL_BITS) - 1
MET_WORDS, MET_BEFORE = 3, 12
TABLE_BITS = 22
OTHER_BLANKS = "\t\r\f\x0b"


def _blanks_as_spaces(text: Column) -> Column:
    """Most texts have no blanks but spaces, and finding that out costs less than replacing."""
    other = reduce(or_, [text.contains(blank) for blank in OTHER_BLANKS])
    return F.when(other, F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(text)


def words_of(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line whose blanks are spaces."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id; d, t, ln: the document's place in the order, a hash of its text, the line's number; k1, k2: hashes of the line, in lower case, with
    spaces for blanks and none at its ends."""
    rows = docs.where(F.col(text).isNotNull())
    rows = rows.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("t"), F.lower(text).alias("text"))
    rows = rows.select("d", "t", _blanks_as_spaces(F.col("text")).alias("text")).select("d", "t", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    rows = rows.select("d", "t", "ln", F.trim("line").alias("line"))
    return rows.select(F.monotonically_increasing_id().alias("id"), "d", "t", "ln", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line")


def _cell_counts(lines: DataFrame) -> Column:
    """One array of bytes: how often the words of each cell occur in all lines, as a level of few steps for each doubling. Its size is fixed,
    and small enough to be looked up quickly."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("cell"))
    counts = words.groupBy("cell").agg(F.count("*").alias("c"))
    cells = lines.sparkSession.range(1 << CELL_BITS).join(counts, F.col("id") == F.col("cell"), "left")
    level = F.least(F.floor(F.log2(F.coalesce("c", F.lit(0)) + 1) * LEVELS_PER_DOUBLING), F.lit((1 << LEVEL_BITS) - 1)).cast("byte").alias("c")
    ordered = cells.agg(F.sort_array(F.collect_list(F.struct("id", level))).alias("p"))
    return ordered.select(F.col("p.c").alias("cells")).scalar()


def _sets(lines: DataFrame) -> DataFrame:
    """The first line of each set of words: k1, k2, id, d, ln, n, all, part, prefix: the set's size, the parities of its words' counts in 64
    cells, and of those with negative hashes alone, and its rarest words as numbers that are ordered by rarity."""
    # Equal lines go first, so that the words of each line are hashed, counted and ordered once.
    rows = lines.where("line != ''").groupBy("k1", "k2").agg(F.min(F.struct("d", "ln", "id", "line")).alias("s"))
    rows = rows.select("k1", "k2", "s.id", "s.d", "s.ln", words_of(F.col("s.line")).alias("words"))
    parities = lambda words: f"aggregate({words}, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"
    part = F.expr(parities("filter(words, x -> x < 0)"))
    rows = rows.select("*", F.size("words").alias("n"), F.expr(parities("words")).alias("all"), part.alias("part")).withColumn("cells", _cell_counts(lines))
    # Spark sorts plain numbers only where it knows that none is null.
    code = f"shiftleft(coalesce(cells[x & {(1 << CELL_BITS) - 1}], 0L), {63 - LEVEL_BITS}) | (x & {HASH_MASK})"
    high, low = SIMILARITY
    # Each column but the words stands here once, so that Spark puts the table of cells where it is used and not into every row.
    first = F.expr(f"slice(sort_array(transform(words, x -> {code})), 1, size(words) - (({high} * size(words) + {low - 1}) div {low}) + 1)")
    return rows.select("k1", "k2", "id", "d", "ln", "n", "all", "part", first.alias("prefix"))


def _overlap(a: str, b: str) -> str:
    high, low = SIMILARITY
    return f"(({high} * ({a}.n + {b}.n) + {high + low - 1}) div {high + low})"


def _differing(a: str, b: str) -> str:
    """At least so many words are in only one of two sets."""
    return f"(bit_count({a}.part ^ {b}.part) + bit_count({a}.all ^ {a}.part ^ {b}.all ^ {b}.part))"


def _near(a: str, b: str) -> str:
    """The filter by parities: with overlap o, a.n + b.n - 2 * o words differ, and (high + low) * o >= high * (a.n + b.n)."""
    high, low = SIMILARITY
    return f"{high + low} * {_differing(a, b)} <= {low - high} * ({a}.n + {b}.n)"


def _alike(a: str, b: str) -> str:
    """The filters for any two sets: sizes and parities."""
    high, low = SIMILARITY
    return f"{low} * {a}.n >= {high} * {b}.n AND {low} * {b}.n >= {high} * {a}.n AND {_near(a, b)}"


def _most() -> str:
    """The size of the largest set that may be similar to a set of n words and share none before the one at place p: overlap <= n - p."""
    high, low = SIMILARITY
    return f"({high + low} * (n - p)) div {high} - n"


def _entries(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each rare word of each set: key, id, d, all, part and size, which holds n, the word's place p and similar. First the words at places
    where a set can still be similar to one of its own size or a larger one, then those where only to smaller ones."""
    words = sets.select("id", "d", "n", "all", "part", "similar", F.posexplode("prefix").alias("p", "key")).withColumn("most", F.expr(_most()))
    size = F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(p as long), 1) | if(similar, 1L, 0L)").alias("size")
    early, late = words.where("most >= n"), words.where("most < n")
    return tuple(part.select("key", "all", "part", "id", "d", size) for part in (early, late))


def _meetings(x: DataFrame, y: DataFrame) -> DataFrame:
    """later, earlier: sets that share a word and may be similar, where the smaller one's word is in x and the other's in y. The later one is
    not known to be similar to an earlier one; in one document, whose lines' numbers are not known here, it can be the earlier one. Of one
    size, the one with the smaller id counts as the smaller."""
    high, low = SIMILARITY
    n, p = (lambda a: f"shiftright({a}.size, 32)"), (lambda a: f"shiftright({a}.size & 4294967295L, 1)")
    both, rest = f"({n('x')} + {n('y')})", (lambda a: f"({n(a)} - {p(a)})")
    later = lambda a, b: f"(({a}.size & 1L) = 0 AND {a}.d >= {b}.d)"
    tests = [
        f"{n('x')} <= {n('y')}", f"{high + low} * {rest('x')} >= {high} * {both}", f"{high + low} * {rest('y')} >= {high} * {both}",
        f"{high + low} * {_differing('x', 'y')} <= {low - high} * {both}",
        f"{high + low} * (least({rest('x')}, {rest('y')}) + least({p('x')}, {p('y')})) >= {high} * {both}",
        f"({n('x')} < {n('y')} OR x.id < y.id)", f"({later('x', 'y')} OR {later('y', 'x')})",
    ]
    met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr(" AND ".join(tests)))
    ordered = F.expr(f"if({later('x', 'y')}, struct(x.id AS later, y.id AS earlier), struct(y.id AS later, x.id AS earlier))")
    return met.select(ordered.alias("pair")).select("pair.later", "pair.earlier")


def _among(ids: DataFrame) -> Column:
    """Whether the column id is in ids. It is true for all of them and, by a table of bits of fixed size, for some others."""
    place = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit((1 << TABLE_BITS - 6) - 1)).cast("int")
    bits = ids.select(F.xxhash64("id").alias("h")).groupBy(place(F.col("h")).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    cells = ids.sparkSession.range(1 << TABLE_BITS - 6).join(bits, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = cells.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("p")).select(F.col("p.bits").alias("bits")).scalar()
    h = F.xxhash64("id")
    return F.getbit(table[place(h)], h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _marked(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """sets with similar: whether the id is in ids. Only those that may be are shuffled."""
    known, maybe = ids.select(F.col("id").alias("known")), _among(ids)
    marked = sets.where(maybe).join(known, F.col("id") == F.col("known"), "left").withColumn("similar", F.col("known").isNotNull()).drop("known")
    return marked.unionByName(sets.where(~maybe).withColumn("similar", F.lit(False)))


def _verified(pairs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """Of distinct pairs: the ids of those that are similar enough to the other and come after it, each once."""
    few = lines.where(_among(pairs.select(F.explode(F.array("later", "earlier")).alias("id")))).select("id", "d", "ln", words_of(F.col("line")).alias("words"))
    few = keep(few.withColumn("n", F.size("words")), "wanted-lines")
    x, y = few.alias("x"), few.alias("y")
    similar = F.expr(f"(x.d, x.ln) != (y.d, y.ln) AND size(array_intersect(x.words, y.words)) >= {_overlap('x', 'y')}")
    both = pairs.join(x, F.col("later") == F.col("x.id")).join(y, (F.col("earlier") == F.col("y.id")) & similar)
    found = keep(both.select(F.expr("if((x.d, x.ln) > (y.d, y.ln), x.id, y.id)").alias("id")).distinct(), name)
    forget(lines.sparkSession, few, pairs)
    return found


def _nearest_before(sets: DataFrame) -> DataFrame:
    """later, earlier: for each set, of a few that come shortly before it among those with one of its rare words, the one that seems nearest."""
    words = F.expr(f"slice(sort_array(transform(prefix, c -> coalesce(c & {HASH_MASK}, 0L))), 1, {MET_WORDS})")
    entries = sets.select("d", "ln", F.struct("id", "n", "all", "part").alias("x"), F.explode(words).alias("word"))
    order = Window.partitionBy("word").orderBy("d", "ln")
    before = F.array(*(F.lag("x", i).over(order) for i in range(1, MET_BEFORE + 1)))
    met = entries.select("x", before.alias("before")).select("x", F.explode("before").alias("y")).where(F.col("y").isNotNull()).where(F.expr(_alike("x", "y")))
    nearest = met.groupBy(F.col("x.id").alias("later")).agg(F.min(F.struct(F.expr(_differing("x", "y")).alias("by"), F.col("y.id").alias("id"))).alias("y"))
    return nearest.select("later", F.col("y.id").alias("earlier"))


def similar_to_earlier(sets: DataFrame, lines: DataFrame) -> DataFrame:
    """id of each of sets that has a similar one with smaller (d, ln)."""
    spark = sets.sparkSession
    near = keep(_nearest_before(sets), "nearest")
    forget(spark)
    decided = _verified(near, lines, "similar-to-nearest")

    # Of two similar sets that share a word, the smaller one's is always among its early ones.
    early, late = _entries(_marked(sets, decided))
    pairs = keep(_meetings(early, early).unionByName(_meetings(early, late)).distinct(), "candidates")
    forget(spark)
    return decided.unionByName(_verified(pairs, lines, "similar-to-others")).distinct()


def remove_similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_counts: bool = False) -> DataFrame:
    """docs with the text of each row without the lines that have an earlier similar one; with_counts adds n_lines and n_removed.

    Lines are parted by line feeds. Two lines are similar if the Jaccard similarity of their sets of words is SIMILARITY or more; earlier is
    by (doc_id, number of the line), null ids last, whether or not the earlier line stays itself. Lines without words always stay. Lines of
    one number in rows with one id are not earlier than each other, so repeated rows get equal texts. A null text stays null and has no
    lines; a text that loses all its lines is empty. An empty table stays empty.
    """
    lines = keep(_lines(docs, doc_id, text), "lines")
    sets = keep(_sets(lines), "line-sets")
    forget(docs.sparkSession)
    similar = similar_to_earlier(sets, lines)

    firsts = _marked(sets, similar).select("k1", "k2", F.struct("d", "ln").alias("first"), "similar")
    # The hinted sides have each key once and short rows; the others, which hold many copies or whole texts, need no sorting then.
    marked = lines.join(firsts.hint("shuffle_hash"), ["k1", "k2"], "left")
    gone = F.coalesce(F.col("similar") | (F.struct("d", "ln") != F.col("first")), F.lit(False))
    # A bit for each line, in order, 64 to a cell: a text of very many lines finds each by its place.
    cells = marked.select("d", "t", "ln", gone.alias("gone")).groupBy("d", "t", F.expr("ln div 64").alias("cell"))
    cells = cells.agg(F.expr("bit_or(if(gone, shiftleft(1L, ln % 64), 0L))").alias("bits"))
    bits = cells.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("cell", "bits"))).alias("cells"))
    bits = keep(bits.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("cells.bits").alias("__bits")).where(F.exists("__bits", lambda b: b != 0)), "line-bits")
    forget(docs.sparkSession, lines, sets, similar)

    keyed = docs.withColumns({"__d1": F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), "__t1": F.xxhash64(text), "__text": F.col(text)})
    both = keyed.join(bits.hint("shuffle_hash"), (F.col("__d1") == F.col("__d")) & (F.col("__t1") == F.col("__t")), "left")
    left = F.expr("filter(split(__text, '\n'), (l, i) -> (shiftright(__bits[cast(i div 64 as int)], cast(i % 64 as int)) & 1) = 0)")
    new = F.when(F.col("__bits").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if with_counts:
        n_lines = F.coalesce(F.when(F.col("__text").isNotNull(), F.size(F.split("__text", "\n"))), F.lit(0)).cast("long")
        removed = F.coalesce(F.expr("aggregate(__bits, 0L, (a, b) -> a + bit_count(b))"), F.lit(0)).cast("long")
        columns += [n_lines.alias("n_lines"), removed.alias("n_removed")]
    return both.select(columns)
