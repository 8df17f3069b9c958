"""Text quality by a generalised additive model with pairwise interactions.

Method: each text becomes a dozen counts and ratios. Every feature is cut into bins at
quantiles of the training rows. Boosting goes round the features in turn; each step fits a
shallow tree to the logistic gradient over one feature's bins and adds a small part of it to
that feature's lookup table. Pairs of features whose joint histogram explains most of what is
left then get tables of their own, filled by the same cyclic boosting with depth-two trees. A
score is the logistic function of the intercept and one table entry per feature and pair, found
by vectorised bin look-ups.

Training uses a bounded sample of labelled rows (``max_rows``, documented, by hash order of the
id); scoring covers every row, needs no shuffle and looks at the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import sliced

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "commonest_word", "upper", "digits",
    "sentence_marks", "symbols", "non_ascii", "spaces", "marked_words", "log_lines", "mean_line", "repeated_lines",
)
MAIN_BINS, PAIR_BINS = 32, 8
RATE = 0.1

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b".,;:?'\"-()"
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _MARKS)
_NON_ASCII = bytes(range(128, 256))
_SPACES = b" \t\n\r\x0b\x0c"


def features_of(raw: bytes) -> list[float]:
    """The features of one text; all are finite, also for the empty text."""
    size = len(raw)

    def share(drop: bytes) -> float:
        return (size - len(raw.translate(None, drop))) / size if size else 0.0

    words = raw.split()
    n = len(words)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    # words that hold a symbol: compare with the words of the text whose symbols are blanked
    marked = sum(1 for word in counts if len(word.translate(None, _SYMBOLS)) != len(word)) / len(counts) if counts else 0.0
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(size), np.log1p(n), (size - n) / n if n else 0.0, float(max(map(len, counts), default=0)),
        len(counts) / n if n else 0.0, max(counts.values(), default=0) / n if n else 0.0,
        share(_UPPER), share(_DIGITS), share(_MARKS), share(_SYMBOLS), share(_NON_ASCII), share(_SPACES), marked,
        np.log1p(len(lines)), size / len(lines) if lines else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


def feature_rows(column: pa.Array) -> np.ndarray:
    values = [features_of(v or b"") for v in column.cast(pa.binary()).to_pylist()]
    return np.array(values, np.float64).reshape(-1, len(FEATURES))


# --- the model ------------------------------------------------------------------------------

@dataclass
class Gam:
    """Lookup tables; ``edges[f]`` are the bin limits of a feature, ``coarse[f]`` those used in pairs."""

    intercept: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _limits(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct quantiles, so that equal values share a bin."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and position of the best cut of a row of bins; position 0 is no cut."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin of a tree over one feature's bins."""
    _, cut = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, ridge), _tree(g[cut:], h[cut:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the better depth-two tree over a pair: one feature, then the other."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            values, gain = np.empty_like(gg), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[rows].sum(0), hh[rows].sum(0)
                leaf = _tree(gs, hs, 1, ridge)
                gain += float((2 * gs * leaf - (hs + ridge / len(gs)) * leaf ** 2).sum())
                values[rows] = leaf
            if gain > best[0]:
                best = (gain, values.T if flip else values)
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, *, rounds: int = 150, pair_rounds: int = 40, pairs: int = 6, ridge: float = 5.0) -> Gam:
    """Fit tables to labels 0 and 1. Without rows of both labels all scores equal the smoothed label share."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    model = Gam(
        float(np.log(share / (1 - share))), [_limits(x[:, f], MAIN_BINS) for f in range(width)],
        [_limits(x[:, f], PAIR_BINS) for f in range(width)], [],
    )
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    fine = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(width)]
    rough = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(width)]
    logit = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(fine[f], g, n), np.bincount(fine[f], h, n), 2, ridge)
            model.tables[f] += step
            logit += step[fine[f]]

    def histogram(a, b, values):
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {ab: _pair_tree(histogram(*ab, g), histogram(*ab, h), ridge)[0] for ab in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda ab: (-gains[ab], ab))[:pairs]
    model.pairs = {ab: np.zeros((len(model.coarse[ab[0]]) + 1, len(model.coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(pair_rounds):
        for (a, b), values in model.pairs.items():
            g, h = slopes()
            step = RATE * _pair_tree(histogram(a, b, g), histogram(a, b, h), ridge)[1]
            values += step
            logit += step[rough[a], rough[b]]
    return model


# --- on tables ------------------------------------------------------------------------------

def remainder(id_column: Column, modulus: int) -> Column:
    return F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % modulus


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> Gam:
    """Fit on at most ``max_rows`` labelled rows of ``docs(doc_id, text)``, first in hash order of the id.

    ``labels(doc_id, quality)``; rows with a null id or a label other than 0 and 1 are not used.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    order = F.xxhash64("doc_id")
    chosen = usable.withColumn("h", order).orderBy("h", "doc_id", "quality").limit(max_rows).drop("h")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def run(batches):
        for batch in sliced(batches, "text"):
            rows = feature_rows(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], names=["x", "y"]
            )

    found = sample.mapInArrow(run, "x array<double>, y double").limit(max_rows).collect()
    # A fixed order makes the sums, and so the model, repeatable.
    found = sorted((tuple(r["x"]), r["y"]) for r in found)
    x = np.array([f[0] for f in found], np.float64).reshape(-1, len(FEATURES))
    return fit_gam(x, np.array([f[1] for f in found], np.float64))


def score_quality(docs: DataFrame, model: Gam, *, text_col: str = "text", output: str = "score") -> DataFrame:
    """The rows of ``docs`` without ``text_col`` and with ``output``: how likely label 1 is, 0 to 1.

    Null texts count as empty; an existing column ``output`` is replaced.
    """
    passed = [f for f in docs.schema.fields if f.name not in (text_col, output)]
    names = [f.name for f in passed]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, text_col):
            at = batch.schema.names.index
            scores = shared.value.scores(feature_rows(batch.column(at(text_col))))
            yield pa.RecordBatch.from_arrays([*[batch.column(at(n)) for n in names], pa.array(scores)], names=[*names, output])

    schema = T.StructType([*passed, T.StructField(output, T.DoubleType())])
    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)
