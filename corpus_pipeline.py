"""A training corpus from ``documents``: languages, repeated lines, near copies, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it again as the next one's input, so a lost executor costs at
most tasks of the running stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from imgtables.llm.byte_bpe import encode_texts, read_ranks
from imgtables.llm.language_crf import UNDETERMINED, fit_language_crf, identify_languages
from imgtables.llm.line_dedup import drop_repeated_lines
from imgtables.llm.mixing import count_tokens, mixture_plan, realise
from imgtables.llm.near_copies import drop_near_copies
from imgtables.session import materialize, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_CERTAINTY = 0.4  # mean probability of each word's own likeliest language; texts that switch languages pass
SHINGLE_WORDS = 5
ENTROPY_SHARE = 0.25  # how far from the corpus' own mixture towards equal weights
MAX_REPEATS = 4.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts whose words no language holds go; a missing language is filled in."""
    ship(spark)
    model = fit_language_crf(docs.select("doc_id", "text", "lang"))
    found = identify_languages(docs, model, keep_text=True)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= MIN_CERTAINTY))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and with them documents that have nothing else."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard of word shingles 0.8 or more) the document with the smallest id stays.

    SimHash fingerprints nominate, words decide; what fingerprints cannot tell is found from shingle sets.
    A row without an id stays only if no row of its group has one, and then alone.
    """
    ship(spark)
    return drop_near_copies(docs, width=SHINGLE_WORDS).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their mixed weights, each document at least once; rows repeat by epoch."""
    plan = mixture_plan(count_tokens(docs), entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS, keep_all=True)
    return realise(docs, plan).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: doc_id, lang, source, ids, n_tokens, decoded_sha256."""
    ship(spark)
    vocabulary = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_texts(
        docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN,
        outputs=("ids", "n_tokens", "decoded_sha256"),
    )


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None  # the first and the last stage have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
