"""Removal of repeated lines by an exact set-similarity join.

Method: a line is the set of its words; two lines match at a Jaccard similarity of at least
``THRESHOLD``. Words are ordered by rarity, counted over the whole corpus. Matching sets share a
word among their rarest ``n - ceil(t * n) + 1`` (prefix filter), their sizes differ by at most the
factor ``t`` (length filter), the words that follow the shared one must suffice for the overlap
(positional filter), and 64-bit parity sketches of the sets differ in no more bits than matching
sets may differ in words. Candidates are verified on the words themselves. A line goes if any
earlier line matches it, earlier by id and then by line number, judged on the input.

One earlier match is enough, so a large group of near copies is not expanded into all its pairs:
for the ``HEADS`` commonest prefix words each line first meets the earliest line that has the word,
which settles almost all members of such groups. All lines that are still unsettled then meet all
earlier lines that share a prefix word. Equal lines are one class from the start and are combined map-side, so neither a
line that a third of all documents have nor its copies meet in one task. Everything is DataFrame
code. Two fixed-size arrays travel with the plans as scalar subqueries: the rarity of word hashes
(``2**RARITY_BITS`` bytes) and a filter of candidate lines; both cover all data, and a collision
in them costs time but changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import bounded_broadcasts, materialize, passing_tables, unless_small

THRESHOLD = (4, 5)  # numerator and denominator, so that bounds are whole numbers
RARITY_BITS = 20
LOW_BITS = 10  # the fixed arrays are arrays of arrays of 2**10 bytes
HEADS = 10_000  # commonest prefix words whose earliest line is tried first; changes no result
WIDE = 8  # words of 64 bits in the sketches of candidates; changes no result
LAST = (1 << 63) - 1  # a row without an id comes after all others


def words_of(line: Column) -> Column:
    """The blank-separated words of a line, with repeats."""
    return F.array_remove(F.split(line, " "), "")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _slot(h: Column) -> tuple[Column, Column]:
    """Row and column of a hash in a fixed array."""
    row = F.shiftrightunsigned(h, 64 - RARITY_BITS + LOW_BITS).cast("int")
    column = F.shiftrightunsigned(h, 64 - RARITY_BITS).bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")).cast("int")
    return row, column


def _fixed_array(hashes: DataFrame, code: Column) -> Column:
    """``code`` of the number of rows per slot of ``hashes(h)``, as a scalar subquery: array<array<tinyint>>."""
    spark: SparkSession = hashes.sparkSession
    slots = hashes.select(F.shiftrightunsigned("h", 64 - RARITY_BITS).alias("slot"), F.lit(1).cast("long").alias("n"))
    every = spark.range(1 << RARITY_BITS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    counts = slots.groupBy("slot").agg(F.sum("n").alias("n")).unionByName(every)
    packed = counts.groupBy("slot").agg(F.sum("n").alias("n")).select(
        F.shiftright("slot", LOW_BITS).alias("row"), (F.col("slot") % (1 << LOW_BITS) * 256 + code).alias("v")
    )
    rows = packed.groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list("v")), lambda v: (v % 256).cast("tinyint")).alias("codes")
    )
    whole = materialize(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "codes"))), lambda r: r["codes"]).alias("a")))
    return whole.scalar()


def _code_at(array: Column, h: Column) -> Column:
    row, column = _slot(h)
    return F.get(F.get(array, row), column)


def _class(line: Column) -> list[Column]:
    """128 bits of hash that name a distinct line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _key(doc_id: Column, line_no: Column) -> Column:
    """Order of lines as one number; decimals are combined in the hash aggregation's own buffers."""
    return F.coalesce(doc_id, F.lit(LAST)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")


def _prefix_size(n: Column) -> Column:
    num, den = THRESHOLD
    return (n - F.floor((n * num + (den - 1)) / den) + 1).cast("int")


def _classes(lines: DataFrame) -> DataFrame:
    """Distinct lines of ``lines(line, key)`` in order of first appearance.

    Columns: id (grows with ``first``), h1, h2, sketch, n, prefix (word ids, rarest first), first.
    """
    # The empty string between two blanks is counted too, in a slot that no word needs for itself.
    words = lines.select(F.explode(F.split("line", " ")).alias("w"))
    # quarter powers of two up to 2**31 occurrences: 0 to 124
    rarity = _fixed_array(
        words.select(F.xxhash64("w").alias("h")), F.least(F.lit(124), F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * 4)).cast("int")
    )
    every = F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    # The generator pins the hashes, so that they are computed once; above it, Catalyst folds the
    # named subquery into the one expression that reads it, so that no row carries the array.
    pinned = lines.select("key", F.inline(F.array(F.struct(
        *_class(F.col("line")), F.array_remove(every, F.xxhash64(F.lit(""))).alias("hashes")
    ))))
    ordered = F.sort_array(F.transform(
        "hashes", lambda h: F.shiftleft(_code_at(F.col("rarity"), h).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    ))
    one = F.lit(1).cast("long")
    sketch = F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))))
    n = F.size("hashes")
    classes = (
        pinned.select("*", rarity.alias("rarity"))
        .select("key", "h1", "h2", sketch.alias("sketch"), n.alias("n"), F.slice(ordered, 1, _prefix_size(n)).alias("prefix"))
        .groupBy("h1", "h2", "sketch", "n", "prefix").agg(F.min("key").alias("first"))
    )
    # The sample for the ranges reads the aggregation's shuffle, not the texts.
    ranged = classes.repartitionByRange("first").sortWithinPartitions("first")
    return materialize(ranged.withColumn("id", F.monotonically_increasing_id()))


def _wide_sketches(texts: DataFrame) -> DataFrame:
    """``(h1, h2, n, s0, s1, ...)`` of ``texts(h1, h2, words)``: parity sketches of sets of words, combined map-side."""
    place = F.xxhash64("w").bitwiseAND(64 * WIDE - 1).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63))
    placed = texts.select("h1", "h2", F.explode("words").alias("w")).select("h1", "h2", place.alias("place"))
    return placed.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), *[F.bit_xor(F.when(F.shiftright("place", 6) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(WIDE)]
    )


def _close(a: str = "_a", b: str = "_b") -> Column:
    """Length filter and parity sketches of two sets."""
    num, den = THRESHOLD
    na, nb = F.col("n" + a), F.col("n" + b)
    length = (na * den >= nb * num) & (nb * den >= na * num)
    parity = F.bit_count(F.col("sketch" + a).bitwiseXOR(F.col("sketch" + b))) * (num + den) <= (na + nb) * (den - num)
    return length & parity


def _matching(pairs: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """``(id)`` of classes ``b`` that match their earlier class ``a``, of ``pairs(a, b)``."""
    num, den = THRESHOLD
    facts = classes.select("id", "h1", "h2", "first")
    for s in "ab":
        pairs = pairs.join(facts.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("h1", "h2", "first")]), s)
    pairs = materialize(pairs.filter("first_a < first_b").select("h1_a", "h2_a", "h1_b", "h2_b", "b"))
    sides = [pairs.select(*[F.col(f"{h}_{s}").alias(h) for h in ("h1", "h2")]) for s in "ab"]
    named = materialize(sides[0].unionByName(sides[1]).distinct())
    wanted = _fixed_array(named.select(F.col("h1").alias("h")), F.least(F.col("n"), F.lit(1)).cast("int"))
    texts = materialize(
        lines.filter(_code_at(wanted, F.xxhash64("line")) > 0).select(*_class(F.col("line")), "line")
        .groupBy("h1", "h2", "line").agg(F.count("*").alias("copies")).join(named, ["h1", "h2"], "left_semi")
        .select("h1", "h2", F.array_distinct(words_of(F.col("line"))).alias("words"))
    )
    sketches = materialize(_wide_sketches(texts))
    for s in "ab":
        pairs = pairs.join(sketches.withColumnsRenamed({c: f"{c}_{s}" for c in sketches.columns}), [f"h1_{s}", f"h2_{s}"])
    apart = sum(F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(WIDE))
    likely = apart * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    pairs = materialize(pairs.filter(likely).select("h1_a", "h2_a", "h1_b", "h2_b", "b"))
    for s in "ab":
        pairs = pairs.join(texts.select(*[F.col(h).alias(f"{h}_{s}") for h in ("h1", "h2")], F.col("words").alias(f"w_{s}")), [f"h1_{s}", f"h2_{s}"])
    shared = F.size(F.array_intersect("w_a", "w_b"))
    union = F.size("w_a") + F.size("w_b") - shared
    return pairs.filter(shared * den >= union * num).select(F.col("b").alias("id")).distinct()


def _matched_classes(classes: DataFrame, lines: DataFrame) -> DataFrame:
    """``(id)`` of classes that match an earlier class."""
    num, den = THRESHOLD

    def entries(of: DataFrame, *more: str) -> DataFrame:
        # A prefix is never empty; the outer form only keeps Catalyst from adding a filter on it.
        return of.select("id", "n", "sketch", *more, F.posexplode_outer("prefix").alias("pos", "word"))

    def named(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("word", *[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "word"])

    common = (
        classes.select("id", F.explode_outer("prefix").alias("word")).groupBy("word").agg(F.min("id").alias("id"), F.count("*").alias("holders"))
        .orderBy(F.desc("holders"), "word").limit(HEADS)
    )
    heads = materialize(common.join(classes.select("id", "n", "sketch"), "id").select("word", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "sketch")]))
    early = named(entries(classes), "b").join(F.broadcast(heads), "word").filter((F.col("id_a") < F.col("id_b")) & _close())
    settled = materialize(_matching(early.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), classes, lines))

    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    position = left * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    # Both sides are the same rows and read the same columns, so they are shuffled once; done is never false.
    every = entries(classes.join(settled.withColumn("done", F.lit(True)), "id", "left"), "done")
    late = named(every, "a").join(named(every, "b"), "word").filter(
        F.coalesce("done_a", F.lit(True)) & F.col("done_b").isNull() & (F.col("id_a") < F.col("id_b")) & position & _close()
    )
    pairs = materialize(late.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    return materialize(settled.unionByName(_matching(pairs, classes, lines)).distinct())


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lines, rows)`` of the join.

    ``lines``: one row per line with a word: doc_id, text_hash, line_no, h1, h2 (its class) and
    removed. ``rows``: one row per input row: doc_id, text_hash and n_lines. ``text_hash`` tells
    apart rows that share an id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    worded = every.filter(F.trim("line") != "").withColumn("key", _key(F.col("doc_id"), F.col("line_no")))
    with bounded_broadcasts(docs.sparkSession):
        classes = _classes(worded.select("line", "key"))
        matched = _matched_classes(classes, worded.select("line"))
        decided = materialize(
            classes.select("id", "h1", "h2", "first").join(matched.withColumn("matched", F.lit(True)), "id", "left")
            .select("h1", "h2", "first", F.coalesce("matched", F.lit(False)).alias("matched"))
        )
    marked = worded.select("doc_id", "text_hash", "line_no", "key", *_class(F.col("line"))).join(decided, ["h1", "h2"]).select(
        "doc_id", "text_hash", "line_no", "h1", "h2", (F.col("matched") | (F.col("first") < F.col("key"))).alias("removed")
    )
    counts = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(lines_of(F.col("text"))).alias("n_lines"))
    return marked, counts


def _per_row(marked: DataFrame) -> DataFrame:
    """``(d, t, removed_lines)`` of rows that lose lines."""
    return marked.filter("removed").withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).groupBy("d", "t").agg(
        F.sort_array(F.collect_set("line_no")).alias("removed_lines")
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed_lines (from 0).

    Blank lines, and so null and
    empty texts, match nothing and stay. Lines at the same place of rows that share an id do
    not remove each other; a row without an id comes last. An empty table gives an empty
    result. Other columns are not read.
    """
    marked, counts = repeated_lines(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return counts.join(_per_row(marked), same, "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; rows that lose every word go.

    Rows that had no word before, null texts among them, stay as they are. Rows with the same id
    and text lose the same lines. Other columns pass through under any name; an empty table stays
    empty.
    """
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # no name of the caller's meets one used here
    id_at, text_at = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    with passing_tables(docs.sparkSession) as keep, bounded_broadcasts(docs.sparkSession):
        marked, _ = repeated_lines(plain, id_at, text_at)
        gone = keep(materialize(_per_row(marked)))
    same = F.col(id_at).cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.col(text_at).cast("string")) == F.col("t"))
    joined = plain.join(unless_small(gone), same, "left")
    kept = F.filter(lines_of(F.col(text_at)), lambda line, i: ~F.array_contains("removed_lines", i))
    text = F.when(F.col("removed_lines").isNull(), F.col(text_at)).otherwise(F.array_join(kept, "\n"))
    some = F.trim(F.replace(F.col(text_at), F.lit("\n"), F.lit(""))) != ""
    return joined.withColumn(text_at, text).filter(F.col("removed_lines").isNull() | some).select(*plain.columns).toDF(*docs.columns)
