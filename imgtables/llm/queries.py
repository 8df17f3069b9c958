"""Queries of the numbered operators over the driver tables, and their SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from ..session import checkpoint_root

from .alignment import TokenizerPair, align_texts
from .ann_forest import nearest_by_inner_product
from .byte_bpe import encode_texts, read_ranks
from .exact_dedup import exact_dedup
from .language_crf import fit_language_crf, identify_languages
from .line_dedup import line_report
from .mixing import count_tokens, mixture_plan, realise
from .prefix_trie import prefix_trie
from .quality_gam import fit_quality, remainder, score_quality
from .registry import ORACLES, QUERIES, query, table
from .repeats import remove_repeats
from .simhash import simhash_components
from .toxicity import fit_toxicity, score_toxicity
from .warc import read_archive, write_archive

__all__ = ["ORACLES", "QUERIES"]


@query("op9_exact_dedup", """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""")
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    vocabulary = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_texts(
        table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op8_ann_forest")
def op8_ann_forest(spark, sf_dir):
    return nearest_by_inner_product(table(spark, sf_dir, "embeddings"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::BIGINT >> {15 - 5 * (i % 4)}) % 32 + 1, 1)"
    for i in range(32)
)


@query("op7_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
""")
def op7_warc(spark, sf_dir):
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_gam")
def op6_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 4) != 2)
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op1_language_crf")
def op1_language_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_crf(docs.filter(remainder(F.col("doc_id"), 5) != 0))
    return identify_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "n_words", "n_switches"
    )


@query("op3_mixing", r"""
WITH RECURSIVE n AS MATERIALIZED (
    SELECT doc_id, source, coalesce(source, '') AS s, coalesce(doc_id::VARCHAR, '') AS id,
           greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS n_tokens
    FROM documents
),
t AS MATERIALIZED (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM n GROUP BY s),
h AS MATERIALIZED (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM t)::DOUBLE AS share FROM t),
ends AS (SELECT -sum(share * ln(share)) AS h1, ln(count(*)) AS h0 FROM h),
bisected(i, low, width) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN low ELSE low + width / 2 END, width / 2
    FROM (
        SELECT i, low, width,
               ln(sum(p)) - sum(p * ln(p)) / sum(p) <= any_value(h1 + 0.5 * (h0 - h1)) AND max(p / share) / sum(p) <= 4.0 AS ok
        FROM (SELECT b.i, b.low, b.width, share, pow(share, b.low + b.width / 2) AS p, h1, h0 FROM bisected b, h, ends WHERE b.i < 30)
        GROUP BY i, low, width
    )
),
w AS MATERIALIZED (
    SELECT s, tokens, greatest(round(pow(share, alpha) / sum(pow(share, alpha)) OVER (), 12), 1e-12) AS weight
    FROM h, (SELECT low + width AS alpha FROM bisected WHERE i = 30)
),
plan AS MATERIALIZED (
    SELECT s, budget // tokens AS full_epochs, budget % tokens AS rest, ceil(tokens / 100000.0)::BIGINT AS n_blocks
    FROM (SELECT s, tokens, floor(weight * (SELECT sum(tokens) FROM t)::DOUBLE)::BIGINT AS budget FROM w)
),
shown AS MATERIALIZED (
    SELECT *, ((u * n_blocks) >> 32) AS block
    FROM (
        SELECT *, ('0x' || substr(md5('2026:' || epoch || ':' || id), 1, 8))::BIGINT AS u
        FROM (SELECT n.*, full_epochs, rest, n_blocks, unnest(generate_series(0, full_epochs)) AS epoch FROM n JOIN plan USING (s))
    )
),
ordered AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY block) AS upto,
           sum(n_tokens) OVER (PARTITION BY s, epoch ORDER BY u, id) AS taken
    FROM shown
),
cuts AS (SELECT s, min(block) AS cut_block FROM ordered WHERE epoch = full_epochs AND upto > rest GROUP BY s)
SELECT doc_id, source, n_tokens, epoch AS mix_epoch, block AS mix_block
FROM ordered JOIN cuts USING (s)
WHERE epoch < full_epochs OR block < cut_block OR (block = cut_block AND taken <= rest)
""")
def op3_mixing(spark, sf_dir):
    counted = count_tokens(table(spark, sf_dir, "documents"))
    plan = mixture_plan(counted, entropy_share=0.5, max_repeats=4.0)
    return realise(counted, plan)


@query("op5_repeats", """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d)
),
hit AS (SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS low FROM w GROUP BY s) USING (s) WHERE low < doc_id),
started AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS fresh FROM hit),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM started),
spans AS MATERIALIZED (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, len(h) // 2) - f)), '' ORDER BY f) AS kh
    FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
""")
def op5_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_line_dedup")
def op2_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


_CRC32 = """xor(list_reduce(
    flatten(list_transform(string_split(c::VARCHAR, ''), ch -> [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT
), 4294967295)""".replace("ch ->", "lambda ch:")


@query("op11_prefix_trie", f"""
WITH t AS MATERIALIZED (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS pos, r, x
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
),
k AS (SELECT c, c - c % 5 AS b, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS MATERIALIZED (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, r, x
    FROM (
        SELECT k.c, pos, r, x FROM k JOIN t ON t.c = k.b AND pos <= h
        UNION ALL SELECT k.c, pos, r, x FROM k JOIN t ON t.c = k.c AND pos > h
    )
),
path AS MATERIALIZED (
    SELECT c, d, strlen(x) AS n, string_agg(sha256(strlen(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d) AS p FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM k
),
sizes AS (SELECT c, max(d) AS len FROM path GROUP BY c),
node AS MATERIALIZED (SELECT p, d, min(c) AS c, count(*) AS n_convs, any_value(n) AS n FROM path GROUP BY p, d),
kids AS (SELECT left(p, 64 * (d - 1)) AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
ends AS (SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM path JOIN sizes USING (c) WHERE d = len GROUP BY p),
below AS (
    SELECT a.p, sum((u.n_convs - 1) * u.n)::BIGINT AS saved, count(*) FILTER (WHERE kids.p IS NULL) AS leaves
    FROM node u JOIN path a ON a.c = u.c AND a.d <= u.d LEFT JOIN kids ON kids.p = u.p GROUP BY a.p
)
SELECT node.c AS conv_id, node.d AS depth, CASE WHEN node.d > 0 THEN up.c END AS parent_conv_id, node.n_convs,
       coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM node LEFT JOIN kids ON kids.p = node.p LEFT JOIN ends ON ends.p = node.p JOIN below ON below.p = node.p
LEFT JOIN node up ON up.d = node.d - 1 AND up.p = left(node.p, 64 * (node.d - 1))
""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    pair = TokenizerPair(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return align_texts(table(spark, sf_dir, "documents"), pair)
