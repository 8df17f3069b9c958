"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are the runs of 4, 6 and 8 characters inside lower-cased words with one blank on either
side, so inflected and compounded forms of a word share terms in any language. The vocabulary
holds the terms whose association with the label, by chi-square over the examples, no chance
explains; document frequencies of its terms are counted over all documents.

Examples lie in blocks. For every term the index keeps its postings and, per block, the largest
weight in it. A query adds those maxima into an upper bound per block, scores blocks from the
highest bound down, and stops once no bound reaches its k-th best cosine: the neighbours are
exactly those of a full scan. Neighbours vote with their cosine, and an isotonic map fitted on
the examples, each voted on by the others, turns the vote into a probability.

What is shared with tasks is bounded by ``max_examples`` and ``max_terms``, whatever the tables
hold. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import sliced

WIDTHS = (4, 6, 8)
BLOCK = 64  # examples in a block of the index
NEIGHBOURS = 16
CHI_SQUARE = 20.0  # by chance about one term in 130,000 reaches it
PIECE = 1 << 20  # bytes of text turned into terms at once
_SIEVE = np.uint64((1 << 20) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- terms ------------------------------------------------------------------------------------


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which characters belong to words: letters and digits of ASCII, and everything above it but blanks and signs."""
    ascii_word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122))
    return ascii_word | (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes < 0x2070)) & (codes != 0x3000)


def terms_of(texts: list[str | None], sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text, term)`` of every occurrence; terms are 64-bit hashes of runs of ``WIDTHS`` characters.

    ``sieve`` leaves only terms whose last twenty bits it marks.
    """
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + "".join(t + "  " for t in lower)).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in lower])
    word = _letters(codes)
    codes = np.where(word, codes, 32).astype(np.uint64)
    owners, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    term, inner, width = np.zeros(len(codes), np.uint64), np.ones(len(codes), bool), 0
    for wanted in WIDTHS:
        n = len(codes) - wanted + 1
        if n <= 0:
            break
        term, inner = term[:n], inner[:n]
        while width < wanted:
            if width > 1:  # the character that was last so far is now inside, where no blank may be
                inner = inner & word[width - 1:width - 1 + n]
            term = (term ^ codes[width:width + n]) * _MIX
            term ^= term >> np.uint64(29)
            width += 1
        kept = inner & word[1:n + 1]
        if sieve is not None:
            kept &= sieve[term & _SIEVE]
        at = np.flatnonzero(kept)
        owners.append(np.searchsorted(ends, at + 1, "right"))
        terms.append(term[at] ^ np.uint64(wanted))
    return np.concatenate(owners), np.concatenate(terms)


def sieve_of(vocabulary: np.ndarray) -> np.ndarray:
    """Marks the last twenty bits of the vocabulary's terms, for every width."""
    found = np.zeros(int(_SIEVE) + 1, bool)
    for width in WIDTHS:
        found[(vocabulary ^ np.uint64(width)) & _SIEVE] = True
    return found


def _pieces(batches, text_col: str, keep: list[str]) -> Iterator[tuple[list, list[str | None]]]:
    """Columns ``keep`` and the texts of slices of bounded size."""
    for batch in sliced(batches, text_col, PIECE):
        at = batch.schema.names.index
        raw = batch.column(at(text_col)).cast(pa.binary()).to_pylist()
        yield [batch.column(at(c)) for c in keep], [(v or b"").decode("utf-8", "replace") for v in raw]


def _counted(texts: list[str | None], vocabulary: np.ndarray, sieve: np.ndarray):
    """``(text, index of the term, occurrences)`` of the vocabulary's terms, ordered by text and index."""
    owner, term = terms_of(texts, sieve)
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
    code, times = np.unique(owner[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
    return code // max(len(vocabulary), 1), code % max(len(vocabulary), 1), times


# --- index ------------------------------------------------------------------------------------


@dataclass
class BlockMaxIndex:
    """Postings of weighted examples with the largest weight of each term in each block."""

    ids: np.ndarray  # id of the example at each position
    labels: np.ndarray
    starts: np.ndarray  # (terms, blocks + 1) into the postings
    places: np.ndarray  # position of each posting, ordered by term
    weights: np.ndarray
    tops: np.ndarray  # (terms, blocks)

    @classmethod
    def build(cls, ids, labels, rows, terms, weights, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """From entries ``(row, term, weight)``; rows with the same strongest terms become neighbours."""
        n = len(ids)
        first = np.full(n, n_terms, np.int64)
        heavy = np.lexsort((terms, -weights, rows))
        lead = heavy[np.r_[True, np.diff(rows[heavy]) != 0]] if len(rows) else heavy
        first[rows[lead]] = terms[lead]
        order = np.lexsort((ids, first))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.lexsort((place[rows], terms))
        places, term, weight = place[rows][by], terms[by], weights[by]
        blocks = -(-n // block)
        cell = term * blocks + places // block
        starts = np.searchsorted(cell, np.arange(n_terms * blocks + 1)).astype(np.int64)
        tops = np.zeros(n_terms * blocks)
        np.maximum.at(tops, cell, weight)
        lines = np.arange(n_terms)[:, None] * blocks + np.arange(blocks + 1)[None, :]
        return cls(ids[order], labels[order], starts[lines], places.astype(np.int32), weight, tops.reshape(n_terms, blocks))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None, block: int = BLOCK):
        """Positions and scores of the ``k`` highest positive inner products, ties to the smaller id.

        ``without`` leaves out the example with this id.
        """
        bounds = weights @ self.tops[terms]
        order = np.argsort(-bounds, kind="stable")[:np.count_nonzero(bounds)]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, max(1, -(-2 * k // block))
        while at < len(order):
            # A bound may lie below its own block's best score by rounding only.
            if len(scores) == k and bounds[order[at]] * (1 + 1e-9) < scores[-1]:
                break
            chosen = order[at:at + step]
            at, step = at + step, step * 2
            low = self.starts[terms[:, None], chosen]
            size = self.starts[terms[:, None], chosen + 1] - low
            flat = size.ravel()
            spot = np.repeat(low.ravel() - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())
            # Positions inside the chosen blocks, so that sums are as short as what is read.
            base = np.arange(len(chosen)) * block - chosen * block
            local = self.places[spot] + np.repeat(np.broadcast_to(base, size.shape).ravel(), flat)
            total = np.bincount(local, np.repeat(weights, size.sum(1)) * self.weights[spot])
            found = np.flatnonzero(total >= scores[-1] if len(scores) == k else total > 0)
            if len(found) == 0:
                continue
            gained = total[found]
            found = found - base[found // block]
            if without is not None:
                other = self.ids[found] != without
                found, gained = found[other], gained[other]
            best, scores = np.concatenate([best, found]), np.concatenate([scores, gained])
            kept = np.lexsort((self.ids[best], -scores))[:k]
            best, scores = best[kept], scores[kept]
        return best, scores


@dataclass
class ToxicityModel:
    """Vocabulary with inverse document frequencies, the index and the map from votes to probabilities."""

    vocabulary: np.ndarray
    sieve: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    k: int
    prior: float
    knots: np.ndarray  # votes
    levels: np.ndarray  # probabilities at the knots

    def vectors(self, owner, at, times):
        """Weights of counted terms, every text of length one."""
        weights = (1 + np.log(times)) * self.idf[at]
        norm = np.sqrt(np.bincount(owner, weights * weights))
        return weights / norm[owner] if len(owner) else weights

    def votes(self, texts: list[str | None], ids: list | None = None):
        """Per text the neighbours' vote and the neighbours; ``ids`` are examples to be left out of their own vote."""
        owner, at, times = _counted(texts, self.vocabulary, self.sieve)
        weights = self.vectors(owner, at, times)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        vote, near = np.full(len(texts), self.prior), []
        for i in range(len(texts)):
            part = slice(cuts[i], cuts[i + 1])
            if cuts[i] == cuts[i + 1]:
                near.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            found, cosine = self.index.nearest(at[part], weights[part], self.k, None if ids is None else ids[i])
            # One neighbour's weight of prior, so that few or far neighbours decide little.
            vote[i] = (cosine @ self.index.labels[found] + self.prior) / (cosine.sum() + 1)
            near.append((found, cosine))
        return vote, near

    def probability(self, vote: np.ndarray) -> np.ndarray:
        return np.interp(vote, self.knots, self.levels) if len(self.knots) else np.full(len(vote), self.prior)


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising step fit of labels on votes; each level leans by one row to the overall rate."""
    if len(votes) == 0:
        return np.zeros(0), np.zeros(0)
    value, where = np.unique(votes, return_inverse=True)
    total, count = np.bincount(where, labels), np.bincount(where).astype(float)
    pools: list[list[float]] = []  # sum, count, lowest vote, highest vote
    for v, s, c in zip(value, total, count):
        pools.append([s, c, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2], high]
    rate = labels.mean()
    levels = np.maximum.accumulate([(p[0] + rate) / (p[1] + 1) for p in pools])
    knots = np.array([[p[2], p[3]] for p in pools]).ravel()
    return knots, np.repeat(levels, 2)


# --- on tables --------------------------------------------------------------------------------


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, max_examples: int = 8192, max_terms: int = 4096, k: int = NEIGHBOURS,
    chi_square: float = CHI_SQUARE,
) -> ToxicityModel | None:
    """Examples, vocabulary, index and calibration from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    At most ``max_examples`` labelled rows, first in hash order of the id, become examples; rows
    with a null id or a label other than 0 and 1 are not used, nor are labels without a document.
    Of terms with a chi-square of ``chi_square`` or more, at most ``max_terms``, strongest first,
    make the vocabulary. Document frequencies are counted over all of ``docs``. None without
    examples. The result does not depend on the order of rows.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def per_term(batches):
        for (label,), rows in _pieces(batches, "text", ["toxic"]):
            owner, term = terms_of(rows)
            value, where = np.unique(term, return_inverse=True)
            where, doc = np.divmod(np.unique(where * len(rows) + owner), len(rows))
            with_one = np.bincount(where, np.asarray(label.to_pylist(), np.int64)[doc], len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(np.bincount(where, minlength=len(value)) - with_one), pa.array(with_one)],
                names=["term", "clean", "toxic"],
            )

    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("one")).first()
    n, one = sizes["n"], sizes["one"]
    if not n:
        return None
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(float(one)) - a, F.lit(float(n - one)) - b
    score = F.lit(float(n)) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * F.lit(float(one) * (n - one)), F.lit(1e-9))
    strong = (
        texts.mapInArrow(per_term, "term long, clean long, toxic long")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .select("term", F.round(score, 6).alias("chi")).filter(F.col("chi") >= chi_square)
        .orderBy(F.desc("chi"), "term").limit(max_terms).collect()
    )
    vocabulary = np.sort(np.array([r["term"] for r in strong], np.int64).view(np.uint64))
    words = docs.sparkSession.sparkContext.broadcast((vocabulary, sieve_of(vocabulary)))

    def frequencies(batches):
        total, seen = np.zeros(len(words.value[0]), np.int64), 0
        for _, rows in _pieces(batches, "text", []):
            _, at, _ = _counted(rows, *words.value)
            total += np.bincount(at, minlength=len(total))
            seen += len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.arange(len(total)), -1]), pa.array(np.r_[total, seen])], names=["at", "df"]
        )

    found = docs.select("text").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    frequency = {r["at"]: r["df"] for r in found}
    idf = np.log((1 + frequency.get(-1, 0)) / (1 + np.array([frequency.get(i, 0) for i in range(len(vocabulary))], float))) + 1

    def entries(batches):
        for (ids, label), rows in _pieces(batches, "text", ["doc_id", "toxic"]):
            owner, at, times = _counted(rows, *words.value)
            cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
            lists = [pa.array([list(map(int, values[i:j])) for i, j in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int64())) for values in (at, times)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), label.cast(pa.int64()), *lists], names=["id", "y", "at", "times"])

    # Documents that repeat an id would each bring a row; the bound holds for rows.
    rows = texts.mapInArrow(entries, "id long, y long, at array<long>, times array<long>").orderBy("id", "at", "times").limit(max_examples).collect()
    ids, y = np.array([r["id"] for r in rows], np.int64), np.array([r["y"] for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([x for r in rows for x in r["at"]], np.int64)
    times = np.array([x for r in rows for x in r["times"]], np.int64)
    model = ToxicityModel(vocabulary, words.value[1], idf, None, k, float(y.mean()) if len(y) else 0.0, np.zeros(0), np.zeros(0))
    model.index = BlockMaxIndex.build(ids, y, owner, at, model.vectors(owner, at, times), len(vocabulary))
    left = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches):
        for (ids, label), rows in _pieces(batches, "text", ["doc_id", "toxic"]):
            vote, _ = left.value.votes(rows, ids.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(vote), label.cast(pa.int64())], names=["vote", "y"])

    votes = texts.mapInArrow(left_out, "vote double, y long").orderBy("vote", "y").limit(max_examples).collect()
    model.knots, model.levels = isotonic(np.array([r["vote"] for r in votes]), np.array([r["y"] for r in votes], float))
    return model


EVIDENCE = T.ArrayType(T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType()),
]))
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, text_col: str = "text", evidence: bool = False) -> DataFrame:
    """The rows of ``docs`` without ``text_col``, with ``score`` (0 to 1) and, if asked, ``evidence``.

    ``evidence``: the nearest examples with cosine and label, nearest first, ties to the smaller
    id. A text without terms of the vocabulary (null and empty ones among them) has no neighbours
    and gets the probability of the examples' overall rate; without a model the score is 0. Other
    columns pass through; ``score`` and ``evidence`` replace columns of those names.
    """
    added = [T.StructField("score", T.DoubleType())] + [T.StructField("evidence", EVIDENCE)] * evidence
    passed = [f for f in docs.schema.fields if f.name not in (text_col, *[f.name for f in added])]
    names = [f.name for f in passed]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for kept, rows in _pieces(batches, text_col, names):
            if fitted is None:
                score, near = np.zeros(len(rows)), [((), ())] * len(rows)
            else:
                vote, near = fitted.votes(rows)
                score = fitted.probability(vote)
            columns = [*kept, pa.array(score)]
            if evidence:
                shown = [
                    [{"doc_id": int(fitted.index.ids[p]), "cosine": float(c), "toxic": int(fitted.index.labels[p])} for p, c in zip(*pair)]
                    for pair in near
                ]
                columns.append(pa.array(shown, _EVIDENCE))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in added]])

    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, T.StructType([*passed, *added]))
