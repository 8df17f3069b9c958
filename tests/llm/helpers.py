"""Brute-force versions of the operators, and tables with every edge case."""

import hashlib
from collections import defaultdict

import numpy as np

CLASHES = "norm string, key long, fp long, ids string, score double, kept boolean, h1 long, line string, bucket long, shard long"


def edge_docs(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with names the operators use inside."""
    texts = [
        (1, "The cat sat on the mat and looked at the dog.\nA second line of words here.", "en", "a"),
        (2, "the cat sat on the mat and looked at the dog.\nA second line of words here.", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, "   \n\n  ", "de", "b"),
        (6, "Der Hund lief durch den Wald und kam nicht zurück. " * 40, "de", "b"),
        (7, "12345 67890 !!! ***", None, "a"),
        (8, "Der Hund lief durch den Wald und kam nicht zurück. " * 40, "de", None),
        (None, "a row without an id but with words", "en", "a"),
        (9, "x" * 30_000 + " \U0001f389 é", "fr", "c"),
        (10, "repeated row", "en", "c"),
        (10, "repeated row", "en", "c"),
        *extra,
    ]
    rows = [(*t, len(t[1] or ""), "n", 1, 2, "i", 0.5, True, 3, "l", 4, 5) for t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def repeats(rows, length=50):
    """``{id: (n_bytes, n_removed, n_spans, kept_sha256)}`` from a dictionary of all windows."""
    low = {}
    for i, text in rows:
        raw = text.encode()
        for s in range(len(raw) - length + 1):
            low[raw[s:s + length]] = min(low.get(raw[s:s + length], i), i)
    out = {}
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if low[raw[s:s + length]] < i:
                gone[s:s + length] = True
        spans = np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1)
        out[i] = (len(raw), int(gone.sum()), spans, sha(np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return out


def repeated_lines(rows):
    """``{id: set of removed line numbers}`` by comparing every line with every earlier one."""
    lines = [(i, k, frozenset(w for w in line.split(" ") if w)) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    gone = defaultdict(set)
    for p, (i, k, words) in enumerate(lines):
        for j, l, other in lines[:p]:
            if (j, l) < (i, k) and 5 * len(words & other) >= 4 * len(words | other):
                gone[i].add(k)
                break
    return gone


def components(ids, prints, distance=3):
    """Smallest id reachable from each row over fingerprints at most ``distance`` bits apart."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    prints = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            parent[find(int(j))] = find(i)
    low = {}
    for i, doc in enumerate(ids):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return [low[find(i)] for i in range(len(ids))]
