"""Near copies of documents: every pair whose sets of word shingles have a Jaccard of 4/5 or more.

1. SimHash nominates: documents whose fingerprints over the same shingles differ in at most three bits,
   found by the grid of segment bit counts (``simhash.near_prints``), are compared, and the links found
   make the first trees.
2. A SimHash distance cannot bound a Jaccard (at 0.8 two 64-bit fingerprints are about ten bits apart,
   give or take three), so the rest is found by an exact way, from prefixes of the shingle sets. A
   document's shingles are ordered by hash; those that are commonest in sampled documents come last.
   Of two sets with a Jaccard of 4/5, the prefixes of ``n - ceil(4n/5) + 1`` shingles share one.
   The sample only shapes the order; under any order all pairs are found.
3. Shingles that only one tree has are settled. Each document is compared with the head that it shares
   most open prefix shingles with, the first document of a shingle's lowest tree; the links found merge
   trees. The step is repeated as long as it finds links, ``ROUNDS`` times at most; so a large group
   becomes one tree without pairing it.
4. Documents of different trees that share a prefix shingle are paired if its places let them reach
   the overlap: a shingle at place ``i`` of ``n`` is of use for partners of at most ``9(n-i)/4 - n``
   shingles. Sizes are part of the join's key, so a shingle that stands too far back in sets of one
   size, as those of a common template do, pairs nobody. Nor does one after which too few open
   shingles follow: those of the first shared one on bound how many a pair shares, so two documents
   that met by chance are not sent as a pair. The number of shared prefix shingles, counted on open
   ones, bounds the overlap once more, and pairs that can reach it are compared.

Comparisons are made on the words, not on hashes. Texts with the same words are one class. As in
SimHash, words are ASCII-lower-cased runs of other bytes than ASCII white space, and a text of fewer
words than a shingle is one shingle.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import bounded_broadcasts, discard, materialize, passing_tables, unless_small
from .batches import sliced
from .components import connected_components
from .simhash import SEED, near_prints, with_fingerprints

SAMPLE = 32  # one document of so many is counted for the order of shingles
HOT_COUNT = 4  # sampled documents that make a shingle common
HOT_SHINGLES = 10_000  # commonest sampled shingles, put last in the order; they are broadcast
ROUNDS = 4  # times that trees are compared by heads; what is left is paired
SIZE_STEP = 1.05  # ratio of set sizes that share a key
FEW_PAIRS = 50_000  # up to so many pairs, the rows in them are broadcast and other texts stay where they are
CACHE_WORDS = 60_000  # words whose hashes a task remembers; only speed depends on it
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: bytes, width: int) -> set[bytes]:
    """The distinct shingles of a text; none without a word."""
    words = text.lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def similar(a: set, b: set) -> bool:
    """Whether two sets have a Jaccard of 4/5 or more; two empty ones do."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


class _Hasher:
    """Distinct shingle hashes of texts, below 2^62; remembers the hashes of words."""

    def __init__(self, width: int):
        self.width, self._words = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = text.lower().split()
        if not words:
            return np.zeros(0, np.int64)
        known = self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w, SEED)
        hashes = np.fromiter(map(known.__getitem__, words), U, len(words))
        n = max(1, len(words) - self.width + 1)
        out = np.full(n, min(len(words), self.width), U)
        for k in range(min(self.width, len(words))):
            out = _mix(out * U(0x9E3779B97F4A7C15) + hashes[k:k + n])
        return np.unique((out >> U(2)).astype(np.int64))


def _prefix(tokens: np.ndarray) -> np.ndarray:
    return tokens[:len(tokens) - (4 * len(tokens) + 4) // 5 + 1]


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs`` with ``_row``, a number of their own, and ``_words``, a digest of the words.

    Columns are called ``_c0`` and so on, so that no name of the caller's meets one used here.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text_at = names.index(text_col)
    docs = docs.toDF(*names)

    def run(batches):
        count = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, names[text_at]):
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            digests = [hashlib.sha256(b" ".join((t or b"").lower().split())).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(range(count, count + len(texts)), pa.int64()), pa.array(digests, pa.binary())], names=[*names, "_row", "_words"]
            )
            count += len(texts)

    schema = T.StructType([*docs.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_words", T.BinaryType())])
    return materialize(docs.mapInArrow(run, schema))


def _prefixes(texts: DataFrame, width: int, hot: np.ndarray, whole: bool = False) -> DataFrame:
    """``(row, n, tokens)`` of ``texts(row, text)``: size of the shingle set and its prefix, or all of it; none without a word."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hasher, last = _Hasher(width), shared.value
        for batch in sliced(batches, "text"):
            out = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                tokens = hasher(text or b"")
                if not len(tokens):
                    continue
                if len(last):
                    common = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
                    tokens = np.concatenate([tokens[~common], tokens[common] + (1 << 62)])
                out[0].append(row)
                out[1].append(len(tokens))
                out[2].append(tokens if whole else _prefix(tokens))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["row", "n", "tokens"])

    return texts.mapInArrow(run, "row long, n long, tokens array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs of a table ``(a, b)`` whose texts are similar; a pass over the texts for as many pairs as there are texts."""
    count = pairs.count()
    if not count:
        return pairs
    if count <= FEW_PAIRS:
        wanted = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        texts, passes = texts.join(F.broadcast(wanted), "row", "left_semi"), 1
    else:
        passes = -(-count // max(1, texts.count()))
    if passes == 1:
        return _compared(pairs, texts, width)
    part = F.pmod(F.xxhash64("a"), F.lit(passes))
    found = [_compared(pairs.filter(part == k), texts, width) for k in range(passes)]
    whole = materialize(functools.reduce(DataFrame.unionByName, found))
    discard(*found)
    return whole


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            keep = [similar(shingle_set(x.as_py() or b"", width), shingle_set(y.as_py() or b"", width)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(both.mapInArrow(run, "a long, b long"))


def _near_by_print(texts: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """Pairs ``(a, b)`` of rows whose fingerprints differ in 3 bits or fewer; rows of one fingerprint meet its first row."""
    prints = materialize(with_fingerprints(texts, width=width).join(copies, "row", "left_anti"))
    firsts = materialize(prints.groupBy("fp").agg(F.min("row").alias("first")))
    same = prints.join(firsts, "fp").filter("first < row").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = materialize(near_prints(firsts.select("fp"))).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    for s in "ab":
        near = near.join(firsts.select(F.col("fp").alias(f"fp_{s}"), F.col("first").alias(s)), f"fp_{s}")
    return same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _trees(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def near_copy_links(texts: DataFrame, copies: DataFrame, width: int) -> DataFrame:
    """Links ``(a, b)`` of ``texts(row, text)`` that join all rows of each group of near copies.

    ``copies(row)`` repeat the words of another row and are left out.
    """
    spark = texts.sparkSession
    with passing_tables(spark) as keep:
        tried = keep(materialize(_near_by_print(texts, copies, width)))
        links = _verified(tried, texts, width)
        labels = keep(_trees(links))
        keep(links)
    with passing_tables(spark) as keep:
        sizes, entries = map(keep, _dealt(texts, copies, width))

    def side(name: str) -> DataFrame:
        return sizes.select(F.col("row").alias(name), F.col("n").alias(f"n_{name}"))

    rest = None
    for turn in range(ROUNDS + 1):
        if rest is not None:
            discard(rest)
        rest = materialize(_open_entries(entries, labels))
        if turn == ROUNDS or rest.isEmpty():
            break
        with passing_tables(spark) as keep:
            pairs = _with_heads(rest, tried).join(side("a"), "a").join(side("b"), "b")
            in_size = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
            reached = 4 * F.col("c") >= F.least(_prefix_size(F.col("n_a")), _prefix_size(F.col("n_b")))
            pairs = keep(materialize(pairs.filter(in_size & reached).select("a", "b")))
            found = keep(_verified(pairs, texts, width))
            tried, links = tried.unionByName(pairs), links.unionByName(found)
            none = found.isEmpty()
            if not none:
                labels = keep(_trees(links))
        if none:
            break
    discard(entries)
    with passing_tables(spark) as keep:
        known = materialize(_placed(rest, sizes))
        discard(rest, sizes)
        able = keep(materialize(_able(known)))
    return links.unionByName(_verified(able, texts, width))


def _prefix_size(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def _dealt(texts: DataFrame, copies: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``sizes(row, n, last)`` of the sets of shingles and of their prefixes' last ones; ``entries(token, row, n, pos)`` of prefix shingles that several have."""
    sample = _prefixes(texts.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0), width, np.zeros(0, np.int64), whole=True)
    common = (
        sample.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= HOT_COUNT)
        .orderBy(F.desc("count"), "token").limit(HOT_SHINGLES).collect()
    )
    hot = np.sort(np.array([r["token"] for r in common], np.int64))
    prefixes = materialize(_prefixes(texts, width, hot).join(copies, "row", "left_anti"))
    dealt = prefixes.select("row", "n", F.posexplode("tokens").alias("pos", "token")).repartition("token")
    several = dealt.groupBy("token").agg(F.min("row").alias("head"), F.max("row").alias("most")).filter("head < most")
    return materialize(prefixes.select("row", "n", F.element_at("tokens", -1).alias("last"))), materialize(dealt.join(several.select("token"), "token", "left_semi"))


def _open_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the ``label`` of their tree, of shingles that several trees have."""
    placed = entries.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    open_ = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return placed.join(open_.select("token"), "token", "left_semi")


def _with_heads(rest: DataFrame, tried: DataFrame) -> DataFrame:
    """``a, b, c``: each row ``b`` with the head of another tree it shares most shingles with, ``c`` of them; no pair twice."""
    heads = rest.groupBy("token").agg(F.min(F.struct("label", F.col("row").alias("head"))).alias("h")).select("token", "h.*")
    heads = heads.withColumnRenamed("label", "low")
    counted = rest.join(heads, "token").filter("label <> low").groupBy(F.col("head").alias("a"), F.col("row").alias("b")).agg(F.count("*").alias("c"))
    # A pair may have been tried in either order.
    both = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = counted.join(both, ["a", "b"], "left_anti")
    best = counted.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), "b", F.col("best.c").alias("c"))


def _placed(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries with ``last``, ``reach``, most shingles of a partner by their place, and ``after``, the row's open ones from there on."""
    after = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("pos"))).cast("long")
    reach = F.floor(9 * (F.col("n") - F.col("pos")) / 4) - F.col("n")
    return rest.withColumns({"after": after, "reach": reach}).join(sizes.select("row", "last"), "row")


def _can_overlap(shared: Column) -> Column:
    """Whether two sets that share so many prefix shingles can be similar.

    All prefix shingles of the set whose prefix ends first that the other set has lie in the other's prefix.
    """
    behind = F.when(F.col("last_a") <= F.col("last_b"), F.col("n_a") - _prefix_size(F.col("n_a"))).otherwise(F.col("n_b") - _prefix_size(F.col("n_b")))
    return 9 * (shared + behind) >= 4 * (F.col("n_a") + F.col("n_b"))


def _met(known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different trees with a prefix shingle at places that let them be similar."""

    def step(size):
        return F.floor(F.log(size.cast("double")) / math.log(SIZE_STEP))

    def steps(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(step(low), step(high))).otherwise(F.array().cast("array<long>"))

    def named(side: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{side}") for c in ("n", "reach", "after", "last", "label")]

    smaller = known.filter("reach >= n").select("token", step(F.col("n")).alias("k"), F.col("row").alias("b"), *named("b"))
    n, after = F.col("n"), F.col("after")
    least, most = F.ceil(n * 4 / 5), F.least("n", "reach")
    # The partner has ``upto`` shingles at most if the own prefix ends first, and ``above`` at least if the partner's does.
    upto = F.floor(9 * (after + n - _prefix_size(n)) / 4) - n
    above = F.ceil((20 * n + 9 - 45 * after) / 16)
    partners = F.array_union(steps(least, F.least(most, upto)), steps(F.greatest(least, above), most))
    larger = known.select("token", F.explode(partners).alias("k"), F.col("row").alias("a"), *named("a"))
    ordered = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    within = (5 * F.col("n_b") >= 4 * F.col("n_a")) & (F.col("n_a") <= F.col("reach_b")) & (F.col("n_b") <= F.col("reach_a"))
    able = _can_overlap(F.least("after_a", "after_b"))
    return larger.hint("merge").join(smaller, ["token", "k"]).filter((F.col("label_a") != F.col("label_b")) & ordered & within & able).select("a", "b").distinct()


def _able(known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that have met and share enough prefix shingles; what rows of different trees share is open in both."""
    opened = materialize(known.groupBy("row", "n", "last").agg(F.collect_list("token").alias("tokens")))
    met = _met(known)
    for s in "ab":
        met = met.join(opened.withColumnsRenamed({"row": s, **{c: f"{c}_{s}" for c in ("n", "last", "tokens")}}), s)
    return met.filter(_can_overlap(F.size(F.array_intersect("tokens_a", "tokens_b")))).select("a", "b")


def _gone(rows: DataFrame, id_at: str, text_at: str, width: int) -> DataFrame:
    """``(_row)`` of rows that are not the first of their group."""
    texts = rows.select(F.col("_row").alias("row"), F.col(text_at).alias("text"))
    classes = rows.groupBy("_words").agg(F.min("_row").alias("row"), F.count("*").alias("copies")).filter("copies > 1")
    copies = rows.select("_row", "_words").join(classes, "_words").filter("_row <> row")
    same = materialize(copies.select(F.col("row").alias("a"), F.col("_row").alias("b")))
    edges = near_copy_links(texts, same.select(F.col("b").alias("row")), width).unionByName(same)
    labels = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = materialize(labels.join(rows.select(F.col("_row").alias("node"), F.col(id_at).alias("id")), "node"))
    best = grouped.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")).alias("best"))
    return grouped.join(best, "label").filter("node <> best.node").select(F.col("node").alias("_row"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id coming last.

    Documents are grouped over links of a Jaccard of 4/5 or more; texts without a word, null ones
    among them, are one group. Equal ids are told apart as rows. Columns pass through under any
    name, and an empty table stays empty.
    """
    text_at, id_at = (f"_c{docs.columns.index(c)}" for c in (text_col, id_col))
    with passing_tables(docs.sparkSession) as keep, bounded_broadcasts(docs.sparkSession):
        rows = keep(_numbered(docs, text_at))
        gone = keep(materialize(_gone(rows, id_at, text_at, width)))
    kept = rows.join(unless_small(gone), "_row", "left_anti").drop("_row", "_words")
    return kept.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
