"""Exact copies, repeated lines, repeated substrings and near copies against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtables import session
from imgtables.errors import ContractError
from imgtables.llm import components, line_dedup, near_copies, repeats, simhash
from imgtables.llm.components import connected_components
from imgtables.llm.exact_dedup import exact_dedup, grow_directory
from imgtables.llm.line_dedup import drop_repeated_lines, line_report
from imgtables.llm.queries import QUERIES
from imgtables.llm.repeats import remove_repeats
from imgtables.llm.simhash import candidate_links, fingerprint_bytes, simhash_components
from . import helpers as H

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not present")


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- exact copies -----------------------------------------------------------------------------

def test_exact_dedup_edges(spark):
    rows = exact_dedup(H.edge_docs(spark), bucket_rows=2).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["keep_id"] == by_id[2]["keep_id"] == 2 and by_id[2]["kept"] and not by_id[1]["kept"]
    assert by_id[3]["keep_id"] == 4 and by_id[3]["group_size"] == 2 and by_id[3]["text_sha256"] == H.sha(b"")
    assert by_id[6]["keep_id"] == 8
    assert by_id[None]["kept"] and by_id[None]["keep_id"] is None
    assert [r["kept"] for r in rows if r["doc_id"] == 10] == [True, True] and by_id[10]["group_size"] == 2
    assert by_id[9]["text_sha256"] == H.sha(("x" * 30_000 + " \U0001f389 é").encode())
    assert exact_dedup(H.empty_docs(spark)).count() == 0


def test_only_ascii_is_folded(spark):
    rows = spark.createDataFrame([(1, "É A"), (2, "é a"), (3, "É a")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(rows).collect()} == {1: 3, 2: 2, 3: 3}


@pytest.mark.parametrize("bucket_rows", [1, 7, 10_000])
def test_directory_covers_every_key_once(spark, bucket_rows):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    depth, buckets = grow_directory(keys, bucket_rows, max_depth=12)
    cells = [c for first, level in buckets for c in range(first, first + (1 << (depth - level)))]
    assert sorted(cells) == list(range(1 << depth))


def test_directory_keeps_an_unsplittable_bucket(spark):
    keys = spark.range(50).select(F.lit(5).cast("long").alias("key"))
    depth, buckets = grow_directory(keys, 10, max_depth=6)
    assert depth == 6 and len(buckets) == 7


# --- repeated lines ---------------------------------------------------------------------------

def near_lines(count, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(words, int(rng.integers(3, 25)))) for _ in range(6)]
    rows = []
    for i in rng.permutation(count).tolist():
        lines = []
        for _ in range(int(rng.integers(0, 4))):
            line = list(base[int(rng.integers(0, 6))])
            for _ in range(int(rng.integers(0, 6))):
                line[int(rng.integers(0, len(line)))] = str(rng.choice(words))
            lines.append("  ".join(line) if rng.random() < 0.2 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_match_brute_force(spark):
    rows = near_lines(250)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = H.repeated_lines(rows)
    got = {r["doc_id"]: r for r in line_report(frame).collect()}
    assert len(got) == 250 and sum(map(len, want.values())) > 100
    for i, text in rows:
        assert set(got[i]["removed_lines"]) == want.get(i, set()) and got[i]["n_lines"] == text.count("\n") + 1
        assert got[i]["n_removed"] == len(want.get(i, ()))


def test_lines_edges(spark):
    docs = H.edge_docs(spark)
    report = line_report(docs).collect()
    by_id = {r["doc_id"]: r for r in report}
    assert len(report) == 12
    assert by_id[2]["removed_lines"] == [0, 1] and by_id[1]["removed_lines"] == []  # one word of nine differs
    assert by_id[8]["n_removed"] == 1 and by_id[6]["n_removed"] == 0
    assert by_id[3]["n_removed"] == by_id[4]["n_removed"] == by_id[5]["n_removed"] == 0
    kept = drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 2 not in ids and 8 not in ids and ids.count(10) == 2 and {3, 4, 5, None} <= set(ids)
    assert line_report(H.empty_docs(spark)).count() == 0 and drop_repeated_lines(H.empty_docs(spark)).count() == 0


def test_long_lines_meet_by_wide_sketches(spark, monkeypatch):
    """Lines of 160 words that share a third of them pass 64 bits, not the wide sketch; near copies pass both."""
    rng = np.random.default_rng(9)
    common, rows = [f"c{i}" for i in range(54)], []
    for i in range(30):
        words = common + [f"x{i}y{k}" for k in range(106)]
        rows += [(3 * i, " ".join(rng.permutation(words))), (3 * i + 1, " ".join([*words[:145], *[f"z{i}{k}" for k in range(14)]]))]
    met, real = [], line_dedup.materialize

    def counted(df):
        out = real(df)
        if df.columns == ["h1_a", "h2_a", "h1_b", "h2_b", "b"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "RARITY_BITS", 12)
    monkeypatch.setattr(line_dedup, "_code_at", lambda array, h: F.lit(1))  # rarest first no longer holds: unlike lines meet
    monkeypatch.setattr(line_dedup, "_prefix_size", lambda n: n)
    monkeypatch.setattr(line_dedup, "materialize", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(r["removed_lines"]) for r in line_report(frame).collect()}
    want = H.repeated_lines(rows)
    assert all(got[i] == want.get(i, set()) for i, _ in rows) and len(want) == 30
    assert max(met) > 500 and met[-1] <= 60, met


def test_prefix_is_long_enough():
    num, den = line_dedup.THRESHOLD
    for n in range(1, 200):
        least = -(-num * n // den)  # smallest overlap of a match with a set of n
        assert n - (n * num + den - 1) // den + 1 == n - least + 1


# --- repeated substrings ----------------------------------------------------------------------

def pieces(count, seed=0):
    rng = np.random.default_rng(seed)
    parts = ["".join(rng.choice(list("ab cdefé"), int(rng.integers(20, 200)))) for _ in range(10)]
    rows = []
    for i in rng.permutation(count).tolist():
        cut = [parts[j][int(rng.integers(0, 5)):len(parts[j]) - int(rng.integers(0, 5))] for j in rng.integers(0, 10, int(rng.integers(0, 5)))]
        rows.append((i, "".join(cut) + ("a" * int(rng.integers(0, 120)) if i % 7 == 0 else "")))
    return rows


@pytest.mark.parametrize("hot_shards", [4096, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot_shards):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 6_000)
    rows = pieces(250)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:5] for r in remove_repeats(frame, hot_shards=hot_shards).collect()}
    want = H.repeats(rows)
    assert got == want and sum(v[1] for v in want.values()) > 10_000


def test_repeats_other_length_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 6_000)
    rows = pieces(80, seed=5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, texts = H.repeats(rows, 33), dict(rows)
    for r in remove_repeats(frame, length=33, keep_bytes=True).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        raw, spans = texts[r["doc_id"]].encode(), r["spans"]
        keep = [raw[a:b] for a, b in zip([0, *[s["end"] for s in spans]], [*[s["start"] for s in spans], len(raw)])]
        assert b"".join(keep) == bytes(r["kept"])
    with pytest.raises(ContractError):
        remove_repeats(frame, length=8)


def test_repeats_edges(spark):
    rows = remove_repeats(H.edge_docs(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12
    assert by_id[8]["n_removed"] == by_id[8]["n_bytes"] > 0 and by_id[6]["n_removed"] == 0  # own repeats do not count
    assert by_id[3]["n_bytes"] == by_id[4]["n_bytes"] == 0 and by_id[3]["kept_sha256"] == H.sha(b"")
    assert by_id[9]["n_removed"] == 0 and by_id[2]["n_removed"] > 0
    assert remove_repeats(H.empty_docs(spark)).count() == 0


def test_contexts_of_two_varying_letters(spark):
    """+4 and +12 in the top bytes of neighbouring words cancel out in a sum of words times factors."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        base = rng.choice(np.frombuffer(b"bcdfgh ", np.uint8), 160)
        base[[70, 78]] = ord("a"), ord("a")
        other = base.copy()
        other[[70, 78]] = ord("e"), ord("m")
        rows += [(4 * i + k, t.tobytes().decode()) for k, t in enumerate((other, base, base[30:], other[20:140]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for hot_shards in (4096, 0):
        assert {r["doc_id"]: tuple(r)[1:5] for r in remove_repeats(frame, hot_shards=hot_shards).collect()} == H.repeats(rows)


def test_colliding_hashes_leave_bytes_to_decide(monkeypatch):
    monkeypatch.setattr(repeats, "_mix", lambda x: x % np.uint64(3))
    rng = np.random.default_rng(8)
    base = rng.integers(97, 100, 300).astype(np.uint8)
    texts = [np.concatenate([base[:150], rng.integers(97, 100, 60).astype(np.uint8)]) for _ in range(4)]
    sizes = np.array([len(t) for t in texts], np.int64)
    shard = repeats.Shard(repeats.Setting(50, 4096), np.arange(4).tobytes(), sizes.tobytes(), b"".join(t.tobytes() for t in texts))
    shard.anchors()
    _, cids, kind, left, right, low, high, found = repeats._contexts(shard, np.unique(shard.keys >> np.uint64(16)), np.zeros(0, np.uint64))
    _, index, times = np.unique(found, axis=0, return_inverse=True, return_counts=True)
    assert len(times) > 3
    np.testing.assert_array_equal(shard.bytes_at(cids.astype(np.int64), shard.setting.width), found)
    lone = np.flatnonzero((low == high) & (times[index.ravel()] == 1))[:1]  # a context of one document, said to be in an earlier one
    one = np.zeros(1, np.uint8)
    gone = repeats.covered_bytes(shard, cids[lone], one, one, np.array([-1]), cids[:0], np.zeros(0, np.int64))
    start = int(cids[lone][0])
    assert gone[start:start + 50].all() and gone.sum() == 50


def test_rows_without_an_id_come_last(spark):
    text = "a passage of text that is long enough to be found again, word for word"
    frame = spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(frame).collect()) == [(0, len(text)), (5, 0), (5, 0)]


# --- near copies ------------------------------------------------------------------------------

@pytest.mark.parametrize("hot_cell", [256, 3, 0])
def test_links_match_brute_force(spark, hot_cell):
    rng = np.random.default_rng(1)
    points = set()
    for x in rng.integers(0, 2**63, 4):
        for _ in range(60):
            y = int(x)
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
                y ^= 1 << int(bit)
            points.add(y - (1 << 64) if y >> 63 else y)
    values = np.array(sorted(points))
    apart = np.bitwise_count(values[:, None].view(np.uint64) ^ values[None, :].view(np.uint64))
    want = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(apart <= 3)) if i < j}
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {(min(r), max(r)) for r in candidate_links(frame, hot_cell=hot_cell).collect()}
    assert got == want and len(want) > 100


def test_fingerprint_by_definition():
    from xxhash import xxh64_intdigest

    for text in (b"", b" \n", b"One", b"one TWO", b"a b c", b"a\x0bb\tc d\x85e a b c", "é ü ß x y".encode()):
        words = text.lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
        assert fingerprint_bytes(text) == sum(1 << b for b in range(64) if bits[b])


def test_simhash_edges(spark):
    rows = simhash_components(H.edge_docs(spark)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12
    assert by_id[2]["component_id"] == 1 and by_id[8]["component_id"] == 6 and by_id[None]["component_id"] is None
    assert {by_id[i]["component_id"] for i in (3, 4, 5)} == {3} and by_id[3]["fingerprint"] == "0" * 16
    assert simhash_components(H.empty_docs(spark)).count() == 0
    with pytest.raises(ContractError):
        simhash_components(H.empty_docs(spark), width=0)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)] + [(201, 200), (200, 201)]
    labels = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- the registered queries over their whole tables ---------------------------------------------

@needs_tables
def test_query_line_dedup(spark):
    want = H.repeated_lines(documents(spark))
    assert all(set(r["removed_lines"]) == want.get(r["doc_id"], set()) for r in QUERIES["op2_line_dedup"](spark, SF).collect())


@needs_tables
def test_query_repeats(spark):
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_repeats"](spark, SF).collect()} == H.repeats(documents(spark))


@needs_tables
def test_query_simhash(spark):
    rows = QUERIES["op10_simhash"](spark, SF).collect()
    texts = dict(documents(spark))
    assert all(int(r["fingerprint"], 16) == fingerprint_bytes(texts[r["doc_id"]].encode()) for r in rows)
    want = H.components([r["doc_id"] for r in rows], [int(r["fingerprint"], 16) for r in rows])
    assert [r["component_id"] for r in rows] == want


def edited(count, seed=7):
    """Documents of 30 to 120 words; most repeat an earlier one with a few words changed."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(count):
        if i % 3 == 0:
            words = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(30, 120)))]
        else:
            words = texts[int(rng.integers(0, len(texts)))].split()
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[int(at)] = f"w{int(rng.integers(0, 500))}"
        texts.append(" ".join(words))
    return [(int(j), texts[i]) for i, j in enumerate(rng.permutation(count))]


@pytest.mark.parametrize("hot", [10_000, 0])
def test_near_copies_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT_SHINGLES", hot)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    rows = edited(240)
    sets = [near_copies.shingle_set(t.encode(), 5) for _, t in rows]
    pairs, scores = [], []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            jaccard = both / (len(sets[i]) + len(sets[j]) - both)
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
                scores.append(jaccard)
    low = {i: rows[i][0] for i in range(len(rows))}
    while any(low[i] != low[j] for i, j in pairs):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r["doc_id"] for r in near_copies.drop_near_copies(frame, width=5).collect())
    assert got == sorted(set(low.values())) and len(got) < 200
    assert sum(0.8 <= s < 0.85 for s in scores) > 5 and sum(0.85 <= s < 0.95 for s in scores) > 20


def test_near_copies_of_a_shared_passage_stay(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"d{i}x{k}" for k in range(20))) for i in range(60)]
    rows += [(100 + i, f"A  long {passage} with one word changed {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(frame).collect()) == [*range(60), 100]


def test_template_documents_are_not_paired(spark, monkeypatch):
    """A third of all rows of one template with two words of sixty changed: no near copies, and no pair of them is looked at."""
    template = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        words = template.copy()
        for p in (15 + i % 13, 40 + i % 11):
            words[p] = f"x{i}y{p}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"d{i}x{k}" for k in range(40))) for i in range(1200)]
    rows += [(5000 + i, " ".join([f"q{k}" for k in range(50)] + [f"n{i}"])) for i in range(20)]  # these are near copies
    met, verified = [], near_copies._met

    def counted(rest):
        pairs = verified(rest)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "_met", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in near_copies.drop_near_copies(frame).collect()}
    assert got == {*range(600), *range(1000, 2200), 5000}
    assert met[0] < 1200, met


def test_stages_stand_every_name_they_use(spark):
    names = [
        "d", "t", "removed_lines", "_row", "_words", "row", "token", "label", "n", "p", "last", "node", "a", "b", "key", "h1", "h2", "line", "line_no",
        "_c0", "_c1", "text_hash", "head", "pos", "tokens", "low", "copies",
    ]
    rows = [(1, "one two three four five six\nsecond line here now"), (2, "one two three four five six\nother"), (2, "x y z"), (None, None), (3, "x y z")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    full = plain.select("*", *[F.lit(f"v_{n}").alias(n) for n in names])
    for stage in (line_dedup.drop_repeated_lines, near_copies.drop_near_copies):
        bare, wide = stage(plain), stage(full)
        assert wide.columns == full.columns
        assert sorted(map(str, wide.select("doc_id", "text").collect())) == sorted(map(str, bare.collect()))
        assert all(r[n] == f"v_{n}" for r in wide.collect() for n in names)


def test_near_copies_without_ids(spark):
    rows = [(None, "one two three"), (None, "One  two three"), (5, "a b c"), (None, "a b c"), (7, None), (8, ""), (9, "a b"), (9, "a b"), (9, "c d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], (r["text"] or "").lower().split()) for r in near_copies.drop_near_copies(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, ["one", "two", "three"]), (5, ["a", "b", "c"]), (7, []), (9, ["a", "b"]), (9, ["c", "d"])], key=str)
    assert near_copies.drop_near_copies(H.empty_docs(spark)).count() == 0


def test_near_prints_are_links(spark):
    """Every link where a cell has one point, and in a star enough that no point is alone."""
    rng = np.random.default_rng(4)
    points = {int(x) for x in rng.integers(0, 2**62, 300)}
    for x in sorted(points)[:150]:
        points.add(x ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    star = {1 << i for i in range(62)} | {0}
    values = np.array(sorted(points | star))
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(apart <= 3)) if i < j}
    got = {tuple(r) for r in simhash.near_prints(spark.createDataFrame([(int(v),) for v in values], "fp long")).collect()}
    assert got <= want and {b for a, b in got if a == 0} >= star - {0}
    assert got >= {p for p in want if not star & set(p)} and 2 * sum(star >= set(p) for p in got) < 62 * 63 // 2


def test_fingerprints_nominate_near_copies(spark, monkeypatch):
    """Without the exact way for the rest, near copies within three bits are still found, by their fingerprints."""
    rng = np.random.default_rng(12)
    rows, want = [], {90, 91}
    for i in range(20):
        base = [f"w{x}" for x in rng.integers(0, 5000, 800)]
        texts = [" ".join(base), " ".join([*base[:300], "other", *base[301:]])]
        rows += [(2 * i + k, t) for k, t in enumerate(texts)]
        a, b = (fingerprint_bytes(t.encode(), 5) for t in texts)
        want |= {2 * i} if (a ^ b).bit_count() <= 3 else {2 * i, 2 * i + 1}
    rows += [(90, " ".join(base[::-1])), (91, "")]
    monkeypatch.setattr(near_copies, "_open_entries", lambda entries, labels: entries.withColumn("label", F.col("row")).limit(0))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in near_copies.drop_near_copies(frame).collect()}
    assert got == want and len(want) < 32


def test_chance_meetings_are_not_sent_as_pairs(spark, monkeypatch):
    """Documents that share one or two passages of six words meet at their shingles, but can't be similar: too few follow."""
    rng = np.random.default_rng(21)
    passages = [[f"p{i}w{k}" for k in range(6)] for i in range(25)]
    rows = []
    for i in range(300):
        own = [f"d{i}x{k}" for k in range(70)]
        rows.append((i, " ".join(sum((passages[int(p)] for p in rng.choice(25, 4, replace=False)), own))))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(5)]  # near copies
    met, real = [], near_copies._met

    def counted(known):
        pairs = real(known)
        met.append((known.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(near_copies, "_met", counted)
    monkeypatch.setattr(near_copies, "HOT_SHINGLES", 0)
    monkeypatch.setattr(near_copies, "near_prints", lambda points: points.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in near_copies.drop_near_copies(frame).collect()}
    assert got == {*range(300)}
    assert met[0][0] > 300 and 5 <= met[0][1] <= 20, met


def test_pairs_are_compared_in_passes(spark, monkeypatch):
    """Few pairs leave other texts where they are; many are compared in passes over the texts. All find the same."""
    words = [f"w{k}" for k in range(40)]
    texts = session.materialize(spark.createDataFrame([(i, " ".join([*words[:38 - 2 * i], *[f"z{i}"] * (2 * i)])) for i in range(8)], "row long, text string"))
    pairs = session.materialize(spark.createDataFrame([(i, j) for j in range(8) for i in range(j)], "a long, b long"))
    few = sorted(map(tuple, near_copies._verified(pairs, texts, 5).collect()))
    monkeypatch.setattr(near_copies, "FEW_PAIRS", 0)
    assert sorted(map(tuple, near_copies._verified(pairs, texts, 5).collect())) == few and 0 < len(few) < 28
    assert near_copies._verified(session.materialize(pairs.limit(0)), texts, 5).isEmpty()


def test_copy_stages_leave_only_what_they_read(spark):
    docs = H.edge_docs(spark)
    for stage, left in ((drop_repeated_lines, 1), (near_copies.drop_near_copies, 2)):
        before = {*session._tables(spark)}
        kept = stage(docs)
        new = [p for p in session._tables(spark) if p not in before]
        folder = session.checkpoint_root(spark).removeprefix("file:")
        assert len(new) == left and sum(f"{folder}/{t}".endswith(p.rsplit("/", 1)[1]) for p in new for t in os.listdir(folder)) == left
        assert kept.count() > 5


def test_passing_tables(spark):
    with session.passing_tables(spark) as keep_outer:
        with session.passing_tables(spark) as keep:
            lost, held, passed = (session.materialize(spark.range(n)) for n in (1, 2, 3))
            keep(held), keep(passed)
        assert held.count() == 2 and lost._imgtables_path not in session._tables(spark)
        keep_outer(held)
    assert held.count() == 2 and passed._imgtables_path not in session._tables(spark)
    with pytest.raises(ZeroDivisionError):
        with session.passing_tables(spark):
            stays = session.materialize(spark.range(4))
            1 / 0
    assert stays.count() == 4
    session.discard(stays, held)
    assert not {stays._imgtables_path, held._imgtables_path} & {*session._tables(spark)}


def test_exploded_cells_are_not_broadcast(spark):
    """Spark sizes the 34 cells of a point as one row; 200,000 points would put seven million rows into the driver."""
    points = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % 2**63,) for i in range(50)], "fp long")
    assert "BroadcastExchange" not in simhash.near_prints(points)._jdf.queryExecution().executedPlan().toString()


def test_copy_stages_bound_what_spark_broadcasts(spark, monkeypatch):
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    for module in (components, line_dedup, near_copies):
        def noted(df, real=module.materialize):
            seen.append(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
            return real(df)

        monkeypatch.setattr(module, "materialize", noted)
    docs = H.edge_docs(spark)
    drop_repeated_lines(docs)
    near_copies.drop_near_copies(docs)
    assert len(seen) > 20 and max(seen) <= session.BROADCAST_BYTES and spark.conf.get(key) == before
    try:
        spark.conf.set(key, "-1")  # a lower bound of the caller's stays
        with session.bounded_broadcasts(spark):
            assert spark.conf.get(key) == "-1"
    finally:
        spark.conf.set(key, before)
    large = session.materialize(spark.range(100_000))
    joined = large.withColumnRenamed("id", "other").join(session.unless_small(large), F.col("id") == F.col("other"), "left_anti")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-2**63, 2**63 - 1, (300, 2))]
    frame = spark.createDataFrame(pairs, "a long, b long")
    bound = F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b"))))
    assert frame.filter(bound > F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).count() == 0
