"""Language identification by a linear-chain conditional random field over words.

Method: a word's state score is the sum of learned weights of its hashed features: affixes of
two to four bytes, byte n-grams of the word with its boundaries, the word itself, and the
language whose training words it belongs to (the lexicon). Transition weights between languages
are learned with them, from chains that join pieces of different documents, so that the model
has seen text switch languages. Forward-backward gives every word's language probabilities; a
document's are the mean over its words, and its language is the largest.

Training takes about ``docs_per_lang`` documents of every language and ``PIECES`` pieces spread over the
whole of each. Every language is learned; the weights take half a megabyte a language on the driver.
Labelling covers every word of every text and needs no shuffle. Texts longer than ``WINDOW``
words are labelled in windows that see ``CONTEXT`` further words on both sides.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import sliced

UNDETERMINED = "und"
TABLE_BITS = 16
PIECE, PIECES, CHAIN = 32, 12, 8  # words a piece, pieces a document, pieces a training chain
BLOCK_CELLS = 2_000_000  # words times languages that training holds at a time
WINDOW, CONTEXT = 1024, 32
CACHE_WORDS = 60_000  # words whose scores a Python worker remembers; only speed depends on it
TEXT_BYTES = 1 << 20  # texts labelled together; a longer text is labelled by itself

_WORD = re.compile(r"[^\W\d_]+")
_GRAMS = (2, 3, 4)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


# --- features -------------------------------------------------------------------------------

def _slots(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(word position, table slot)`` of every feature of every word."""
    raws = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), ends - starts)
    at, slot = [], []
    grams = flat
    for n in range(2, max(_GRAMS) + 1):
        grams = grams[:-1] * np.uint64(257) + flat[n - 1:]
        inside = np.flatnonzero(np.arange(len(grams)) + n <= ends[owner[:len(grams)]]) if len(grams) else np.zeros(0, np.int64)
        at.append(owner[inside])
        slot.append(_slots(grams[inside], n))
        long = np.flatnonzero(ends - starts >= n + 1)  # affixes leave out one boundary
        for salt, place in ((16, starts[long]), (32, ends[long] - n)):
            at.append(long)
            slot.append(_slots(grams[place], n + salt))
    whole = np.array([zlib.crc32(r) for r in raws], np.uint64)
    at.append(np.arange(len(words)))
    slot.append(_slots(whole, 64))
    known = np.array([lexicon.get(w, -1) for w in words], np.int64)
    listed = np.flatnonzero(known >= 0)
    at.append(listed)
    slot.append(_slots(known[listed], 128))
    return np.concatenate(at), np.concatenate(slot)


# --- chains ---------------------------------------------------------------------------------

def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all chains by forward-backward, and expected transition counts.

    ``scores`` holds the words of all chains one after another. Chains run side by side, the
    longest first, so step ``t`` is one matrix product over the chains that reach it.
    """
    states = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left") if len(lengths) else np.zeros(0, np.int64)
    base = np.r_[0, np.cumsum(active)].astype(np.int64)
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    time = np.arange(len(scores)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    place = base[time] + np.repeat(rank, lengths)  # where a word stands, step after step
    local = np.empty_like(scores)
    local[place] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    jump = np.exp(transitions)
    forward, backward = np.empty_like(local), np.ones_like(local)
    for t in range(len(active)):
        now = local[base[t]:base[t + 1]]
        if t:
            now = now * (forward[base[t - 1]:base[t - 1] + active[t]] @ jump)
        forward[base[t]:base[t + 1]] = now / now.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        ahead = (local[base[t + 1]:base[t + 2]] * backward[base[t + 1]:base[t + 2]]) @ jump.T
        backward[base[t]:base[t] + n] = ahead / ahead.sum(axis=1, keepdims=True)
    marginals = forward * backward
    marginals /= marginals.sum(axis=1, keepdims=True)
    counts = np.zeros((states, states))
    follows = np.flatnonzero(time > 0)
    if len(follows):
        here = place[follows]
        before = base[time[follows] - 1] + here - base[time[follows]]
        left, right = forward[before], local[here] * backward[here]
        total = np.einsum("ni,ij,nj->n", left, jump, right, optimize=True)
        counts = jump * ((left / total[:, None]).T @ right)
    return marginals[place], counts


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains for labelling: the words of each window with context, and which of them count."""
    index, kept, sizes = [], [], []
    start = 0
    for n in lengths.tolist():
        if n <= WINDOW + 2 * CONTEXT:
            if n:
                index.append(np.arange(start, start + n))
                kept.append(np.ones(n, bool))
                sizes.append(n)
        else:
            for a in range(0, n, WINDOW):
                low, high = max(0, a - CONTEXT), min(n, a + WINDOW + CONTEXT)
                index.append(np.arange(start + low, start + high))
                inner = np.arange(low, high)
                kept.append((inner >= a) & (inner < a + WINDOW))
                sizes.append(high - low)
        start += n
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    return np.concatenate(index), np.concatenate(kept), np.array(sizes, np.int64)


@dataclass
class LanguageCrf:
    """Languages, state weights (table slot x language), transition weights and lexicon."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        at, slot = features(words, self.lexicon)
        return np.stack([np.bincount(at, self.weights[slot, i], len(words)) for i in range(len(self.langs))], axis=1)


class Labeller:
    """Labels batches of texts; remembers the scores of words it has seen."""

    def __init__(self, model: LanguageCrf):
        self.model = model
        self._row: dict[str, int] = {}
        self._scores = np.zeros((0, len(model.langs)))
        self._letters = np.zeros(0, bool)

    def _forget_all_but(self, words: set[str]) -> None:
        kept = [w for w in words if w in self._row]
        rows = [self._row[w] for w in kept]
        self._row = dict(zip(kept, range(len(kept))))
        self._scores, self._letters = self._scores[rows], self._letters[rows]

    def label(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their marginals one after another, and which words hold a letter."""
        split = [words_of(t) for t in texts]
        needed = set(chain.from_iterable(split))
        new = needed.difference(self._row)
        if len(self._row) + len(new) > CACHE_WORDS:
            self._forget_all_but(needed)
        fresh = list(new)
        self._row.update(zip(fresh, range(len(self._row), len(self._row) + len(fresh))))
        self._scores = np.concatenate([self._scores, self.model.word_scores(fresh)])
        # superscripts and fractions count as word characters but are no letters
        self._letters = np.r_[self._letters, np.array([any(map(str.isalpha, w)) for w in fresh], bool)]
        lengths = np.array([len(s) for s in split], np.int64)
        rows = np.fromiter(map(self._row.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        index, kept, sizes = _windows(lengths)
        marginals = np.zeros((len(rows), len(self.model.langs)))
        if len(index):
            found, _ = posteriors(self._scores[rows[index]], sizes, self.model.transitions)
            marginals[index[kept]] = found[kept]
        return split, marginals, self._letters[rows]


# --- training -------------------------------------------------------------------------------

def fit_chains(pieces: list[tuple[str, list[str]]], *, steps: int = 40, rate: float = 0.15, decay: float = 1e-4) -> LanguageCrf | None:
    """Fit on ``(language, words)`` pieces; neighbouring pieces form chains. None without any word."""
    pieces = [(lang, words) for lang, words in pieces if words]
    if not pieces:
        return None
    langs = sorted({lang for lang, _ in pieces})
    number = {lang: i for i, lang in enumerate(langs)}
    gold = np.concatenate([np.full(len(w), number[lang]) for lang, w in pieces])
    sizes = [len(w) for _, w in pieces]
    lengths = np.array([sum(sizes[i:i + CHAIN]) for i in range(0, len(sizes), CHAIN)], np.int64)
    types: dict[str, int] = {}
    rows = np.fromiter((types.setdefault(w, len(types)) for _, ws in pieces for w in ws), np.int64, len(gold))
    names = list(types)
    seen = np.zeros((len(names), len(langs)))
    np.add.at(seen, (rows, gold), 1)
    # Words of one language alone, seen often enough that their own features do not just repeat the entry.
    sure = (seen.sum(1) >= 5) & (seen.max(1) >= 0.9 * seen.sum(1))
    lexicon = {names[i]: int(seen[i].argmax()) for i in np.flatnonzero(sure)}
    at, slot = features(names, lexicon)
    model = LanguageCrf(langs, np.zeros((1 << TABLE_BITS, len(langs))), np.zeros((len(langs), len(langs))), lexicon)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    second = np.flatnonzero(inner)
    gold_jumps = np.zeros_like(model.transitions)
    np.add.at(gold_jumps, (gold[second - 1], gold[second]), 1)
    block = starts // max(1, BLOCK_CELLS // len(langs))
    blocks = np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(block)) + 1)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(gold_jumps), np.zeros_like(gold_jumps)]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(at, model.weights[slot, i], len(names)) for i in range(len(langs))], axis=1)
        by_type, jumps = np.zeros_like(scores), np.zeros_like(gold_jumps)
        for chains in blocks:
            words = slice(starts[chains[0]], ends[chains[-1]])
            found, met = posteriors(scores[rows[words]], lengths[chains], model.transitions)
            jumps += met
            left = -found
            left[np.arange(len(left)), gold[words]] += 1
            by_type += np.stack([np.bincount(rows[words], left[:, i], len(names)) for i in range(len(langs))], axis=1)
        by_slot = np.stack([np.bincount(slot, by_type[at, i], 1 << TABLE_BITS) for i in range(len(langs))], axis=1)
        slopes = (by_slot / len(gold) - decay * model.weights, (gold_jumps - jumps) / len(gold) - decay * model.transitions)
        for k, (parameter, slope) in enumerate(zip((model.weights, model.transitions), slopes)):
            first, square = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (slope - first)
            square += 0.01 * (slope ** 2 - square)
            parameter += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-7)
    return model


def remainder(id_column: Column, modulus: int) -> Column:
    return F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % modulus


def fit_language_crf(
    docs: DataFrame, *, docs_per_lang: int = 200, steps: int = 40,
) -> LanguageCrf | None:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)`` with text and language; None without one."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(r["lang"], docs_per_lang / r["count"]) for r in counts], "lang string, wanted double")

    def cut(batches):
        for batch in sliced(batches, "text"):
            out = [], [], []
            for i, (lang, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist())):
                words = words_of(raw.decode("utf-8", "replace"))
                slots = max(1, len(words) // PIECE)
                for at in sorted({j * slots // PIECES for j in range(PIECES)}):
                    piece = " ".join(words[at * PIECE:(at + 1) * PIECE])
                    out[0].append(zlib.crc32(f"{at} {piece}".encode("utf-8", "replace")))
                    out[1].append(lang)
                    out[2].append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], names=["h", "lang", "piece"])

    sample = usable.join(F.broadcast(shares), "lang").filter(share < F.col("wanted")).select("text", "lang").mapInArrow(cut, "h long, lang string, piece string")
    pieces = sample.limit(2 * docs_per_lang * len(counts) * PIECES).collect()
    # Order by hash mixes documents and languages, and makes the fit repeatable.
    return fit_chains([(p["lang"], p["piece"].split()) for p in sorted(pieces, key=lambda p: (p["h"], p["lang"], p["piece"]))], steps=steps)


# --- on tables ------------------------------------------------------------------------------

_LABELLERS: dict = {}  # one model at a time, for as long as the Python worker lives


def _labeller(shared) -> Labeller:
    if shared.id not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[shared.id] = Labeller(shared.value)
    return _LABELLERS[shared.id]


class _Shared:
    """A broadcast model and a name that a worker can remember it by."""

    def __init__(self, spark, model: LanguageCrf):
        import uuid

        self.id = uuid.uuid4().hex
        self._cell = spark.sparkContext.broadcast(model)

    @property
    def value(self) -> LanguageCrf:
        return self._cell.value


def identify_languages(docs: DataFrame, model: LanguageCrf | None, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (without the text unless ``keep_text``) with lang_pred, score, n_words, n_switches and certainty.

    ``score`` is the mean probability of ``lang_pred`` over the words; ``certainty`` that of each word's own
    likeliest language, whichever it is; ``n_switches`` counts neighbouring words of different likeliest languages. A null text, a text without a letter, and every text if there is no
    model, is ``und`` with score and certainty 0. Existing columns of these names are replaced.
    """
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_words", T.LongType()), ("n_switches", T.LongType()),
             ("certainty", T.DoubleType())]
    outputs = [name for name, _ in added]
    passed = [f for f in docs.schema.fields if f.name not in outputs and (keep_text or f.name != text_col)]
    names = [f.name for f in passed]
    if model is None:
        values = (F.lit(UNDETERMINED), F.lit(0.0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0))
        return docs.select(*[f"`{n}`" for n in names], *[v.alias(n) for v, n in zip(values, outputs)])
    shared = _Shared(docs.sparkSession, model)

    def run(batches):
        labeller = _labeller(shared)
        langs = labeller.model.langs
        for batch in sliced(batches, text_col, TEXT_BYTES):
            at = batch.schema.names.index
            texts = [(v or b"").decode("utf-8", "replace") for v in batch.column(at(text_col)).cast(pa.binary()).to_pylist()]
            split, marginals, letters = labeller.label(texts)
            lengths = np.array([len(s) for s in split], np.int64)
            owner = np.repeat(np.arange(len(split)), lengths)
            # words without a letter are labelled by their neighbours but do not vote
            weights = letters.astype(np.float64)
            n = np.bincount(owner, weights, len(split))
            sums = np.stack([np.bincount(owner, marginals[:, i] * weights, len(split)) for i in range(len(langs))], axis=1)
            means = sums / np.maximum(n, 1)[:, None]
            best = means.argmax(axis=1)
            top = marginals.argmax(axis=1)
            changed = np.r_[False, (top[1:] != top[:-1]) & (owner[1:] == owner[:-1])] if len(top) else np.zeros(0)
            certain = np.bincount(owner, marginals.max(axis=1) * weights, len(split)) / np.maximum(n, 1)
            score = np.where(n > 0, means[np.arange(len(split)), best], 0.0)
            columns = [
                pa.array([langs[b] if c else UNDETERMINED for b, c in zip(best, n)], pa.string()),
                pa.array(np.clip(score, 0.0, 1.0)), pa.array(n.astype(np.int64)),
                pa.array(np.bincount(owner, changed, len(split)).astype(np.int64)),
                pa.array(np.clip(certain, 0.0, 1.0)),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(n)) for n in names], *columns], names=[*names, *outputs])

    schema = T.StructType([*passed, *[T.StructField(n, kind) for n, kind in added]])
    source = [*names, *([] if keep_text else [text_col])]
    return docs.select(*[f"`{n}`" for n in source]).mapInArrow(run, schema)


def label_words(docs: DataFrame, model: LanguageCrf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, words)``: each text's words in order with the likeliest language and its probability."""
    shared = _Shared(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        labeller = _labeller(shared)
        langs = labeller.model.langs
        for batch in sliced(batches, "text", TEXT_BYTES):
            texts = [(v or b"").decode("utf-8", "replace") for v in batch.column(1).cast(pa.binary()).to_pylist()]
            split, marginals, _ = labeller.label(texts)
            top, at, out = marginals.argmax(axis=1), 0, []
            for words in split:
                out.append([{"word": w, "lang": langs[top[i]], "probability": float(marginals[i, top[i]])} for i, w in enumerate(words, at)])
                at += len(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "words"])

    ddl = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("words", T.ArrayType(T.StructType([
            T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("probability", T.DoubleType()),
        ]))),
    ])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
