"""Prefix trie, toxicity and tokenizer alignment against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from imgtables.llm.alignment import TokenizerPair, align_texts, diagonal_cuts, overlaps
from imgtables.llm.prefix_trie import Parentheses, prefix_trie, shard_edges
from imgtables.llm.quality_gam import remainder
from imgtables.llm.queries import QUERIES
from imgtables.llm.toxicity import BlockMaxIndex, fit_toxicity, isotonic, score_toxicity, sieve_of, terms_of
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not present")

# --- prefix trie ------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, p string, c long, path string, pos long"


def trie_of(rows):
    """Nodes by walking every rebuilt conversation."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [v[2] for v in sorted(found, key=lambda v: v[:2])] for c, found in turns.items()}
    rebuilt = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + found[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, found in rebuilt.items():
        for d in range(len(found) + 1):
            members[tuple(found[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        here = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = here + sum(saved[k] for k in kids[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves[node], saved[node], H.sha(ends.encode())))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1], r[3]))


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS).repartition(5)


def test_find_close_meets_a_stack(rng):
    for _ in range(50):
        bits, depth = [], 0
        for _ in range(int(rng.integers(1, 400))):
            up = depth == 0 or rng.random() < 0.5
            bits.append(up)
            depth += 1 if up else -1
        bits = np.array(bits + [False] * depth)
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        for block in (1, 2, 8, 64):
            assert Parentheses(bits, block).find_close(at).tolist() == [want[i] for i in at]


def test_trie_meets_brute_force(spark, rng):
    rows = []
    for c in range(-7, 90):
        n, kind = (200 if c % 30 == 0 else int(rng.integers(1, 8))), int(rng.integers(0, 3))
        for t in range(n):
            text = ["x", "yy", None, "é"][kind if rng.random() < 0.8 else 3]
            rows.append((c * (1 if c % 3 else 1000), None if rng.random() < 0.1 else t, ["u", None, "a"][t % 3], text))
    rows += [(None, 1, "u", "x"), (1, 3, "u", "x"), (1, 3, "u", "x"), (9999, 0, None, None)]
    assert trie_rows(prefix_trie(conversations(spark, rows))) == trie_of(rows)


def test_trie_with_copies_over_many_shards(spark):
    rows = [(c, t, "u", f"{c % 2 if t < 1 else c % 7 if t < 3 else 'z' * (c % 3)}") for c in range(300) for t in range(5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert trie_rows(prefix_trie(conversations(spark, rows))) == trie_of(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_edges(spark):
    empty = conversations(spark, [(1, 1, "u", "x")]).limit(0)
    assert prefix_trie(empty).collect() == []
    assert prefix_trie(conversations(spark, [(None, 1, "u", "x")])).collect() == []
    # crc32("7") % 9 is above one and the base 5 does not exist: a conversation without turns
    rows = [(7, 0, "u", "x")]
    assert zlib.crc32(b"7") % 9 > 0
    assert trie_rows(prefix_trie(conversations(spark, rows))) == trie_of(rows) and len(trie_of(rows)) == 1


def test_a_leaf_that_goes_on_in_the_next_shard_is_none():
    edges = {"a": [0, 0, 1], "c": [1, 1, 2], "n": [9, 9, 3], "z": [0, 0, 1], "base": [0, 0, 0], "w": [5, 5, 4]}
    edges = {k: np.array(v) for k, v in edges.items()}
    values = shard_edges(np.array([0, 1, 3]), edges, np.array([1, 2]), np.array([6, 1]), np.array(["x", "y"], object), False)
    assert values["ends_sha256"].tolist() == ["x", "y"]
    assert values["n_leaves"].tolist() == [0, 0] and values["saved"].tolist() == [9, 4] and values["n_children"].tolist() == [1, 0]


# --- toxicity ---------------------------------------------------------------------------------

def test_nearest_meets_a_full_scan(rng):
    n, width = 500, 40
    rows, terms = np.divmod(np.flatnonzero(rng.random(n * width) < 0.15), width)
    weights = rng.integers(1, 4, len(rows)).astype(float)  # many ties
    dense = np.zeros((n, width))
    dense[rows, terms] = weights
    ids = rng.permutation(n) * 3
    for block in (1, 16, 64):
        index = BlockMaxIndex.build(ids, ids % 2, rows, terms, weights, width, block)
        for _ in range(40):
            used = np.flatnonzero(rng.random(width) < 0.2)
            value = rng.integers(1, 3, len(used)).astype(float)
            scores = dense[:, used] @ value
            want = [(ids[i], scores[i]) for i in np.lexsort((ids, -scores))[:10] if scores[i] > 0]
            found, got = index.nearest(used, value, 10, block=block)
            assert [(index.ids[p], s) for p, s in zip(found, got)] == want


def test_terms_stay_inside_words():
    owner, term = terms_of(["abc, abc", None, "", "xabc", "ABC"])
    assert set(owner.tolist()) == {0, 3, 4}
    per = [set(term[owner == i].tolist()) for i in range(5)]
    assert per[0] == per[4] and not per[1] and not per[2] and len(per[0] & per[3]) == 1  # "abc " is shared
    sieved = terms_of(["abc, abc"], sieve_of(np.array(sorted(per[0]), np.uint64)))
    assert sorted(sieved[1].tolist()) == sorted(term[owner == 0].tolist())


def test_isotonic_rises():
    knots, levels = isotonic(np.array([0.1, 0.2, 0.3, 0.9, 0.9]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and levels[0] < 0.5 < levels[-1] <= 1


def test_toxicity_learns_and_shows_evidence(spark, rng):
    clean, bad = ["house", "garden", "river", "mountain", "window"], ["grumblefish", "snorkwort"]
    def text(toxic):
        words = list(rng.choice(clean, 30)) + list(rng.choice(bad, 3)) * toxic
        return " ".join(rng.permutation(words))
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (None, text(True)), (7, text(False))], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(None, 1), (5000, 1), (3, 7)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    found = score_toxicity(docs.withColumn("score", F.lit("old")), model, evidence=True).collect()
    assert len(found) == len(rows) + 4
    by_id = {r["doc_id"]: r for r in found}
    held = [by_id[r[0]] for r in rows[300:]]
    assert all((h["score"] >= 0.5) == bool(r[2]) for h, r in zip(held, rows[300:]))
    assert by_id[None]["score"] >= 0.5 and by_id[1000]["evidence"] == [] and by_id[1000]["score"] == by_id[1001]["score"] < 0.5
    evidence = by_id[300]["evidence"]
    assert all(e["toxic"] == 1 and 0 < e["cosine"] <= 1 + 1e-9 for e in evidence)
    assert [-e["cosine"] for e in evidence] == sorted(-e["cosine"] for e in evidence)
    again = fit_toxicity(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.vocabulary, model.vocabulary) and np.array_equal(again.levels, model.levels)


def test_toxicity_edges(spark):
    docs = H.edge_docs(spark)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_toxicity(docs, no_labels) is None
    assert {r["score"] for r in score_toxicity(docs, None).collect()} == {0.0}
    one_class = spark.createDataFrame([(1, 0), (10, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, one_class)
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert score_toxicity(H.empty_docs(spark), model).count() == 0


@needs_tables
def test_query_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0)))
    held = scored.join(labels, "doc_id").filter(remainder(F.col("doc_id"), 5) == 0).collect()
    hit = [r["toxic"] for r in held if r["score"] >= 0.5]
    assert sum(hit) / len(hit) > 0.95 and sum(hit) / sum(r["toxic"] for r in held) > 0.85
    assert {tuple(q) for q in QUERIES["op12_toxicity"](spark, SF).dtypes} == {("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")}


# --- alignment --------------------------------------------------------------------------------

PAIR = TokenizerPair(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    public_tokenizers.path("piece_bpe_32k.model"),
)


def walked(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((i, j, bool(a[i] == b[j])))
        x, y = a[i], b[j]
        i, j = i + (x <= y), j + (y <= x)
    return out


def test_pieces_meet_a_plain_merge(rng):
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n]) for _ in range(2))
        for piece in (1, 2, 3, 7, 1000):
            assert list(zip(*(v.tolist() for v in overlaps(a, b, piece)))) == walked(a, b)
            i, j = diagonal_cuts(a, b, piece)
            assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i + j) <= piece).all()


def aligned(rows):
    a_side, b_side = Tokenizer.from_file(PAIR.a_json), sentencepiece.SentencePieceProcessor(model_file=PAIR.b_model)
    a_side.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    kept, counts = [], Counter()
    for doc, text in rows:
        found = None
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            a_raw = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
            pieces = [b_side.id_to_piece(i) for i in b]
            b_raw = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                links = walked(np.cumsum([len(x) for x in a_raw]), np.cumsum([len(x) for x in b_raw]))
                counts.update((a[i], b[j]) for i, j, _ in links)
                found = a, b, links
        kept.append((doc, found))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, found in kept:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links = found
        groups, p, q = [], 0, 0
        for i, j, closes in links:
            if closes:
                groups.append(",".join(map(str, a[p:i + 1])) + "|" + ",".join(map(str, b[q:j + 1])))
                p, q = i + 1, j + 1
        n = [counts[a[i], b[j]] for i, j, _ in links]
        top = sum(x == best[b[j]] for x, (_, j, _) in zip(n, links))
        out.append((doc, len(a), len(b), len(groups), len(links), top, sum(n), H.sha(";".join(groups).encode())))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_alignment_meets_brute_force(spark):
    texts = ["▁ a", "<|endoftext|> x </s> <unk>", "  double  spaces ", "퟿ \U0001f389 é \x00 ﬁ", "tab\tnl\n", "word " * 3000, "Straße " * 50]
    docs = H.edge_docs(spark, [(100 + k, t, "en", "a") for k, t in enumerate(texts)])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, align_texts(docs, PAIR).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == aligned(rows)
    assert align_texts(H.empty_docs(spark), PAIR).count() == 0


@needs_tables
def test_query_alignment(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op13_alignment"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == aligned(rows)
