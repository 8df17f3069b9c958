"""Mixing sources to target weights by temperature.

Method: a source's weight is its share of all tokens to the power ``alpha``, normalised. With
``alpha`` 1 the mixture is the corpus, with 0 all sources weigh the same. ``alpha`` is bisected
on a fixed grid of ``2**-30`` so that the mixture meets a target entropy or stays within a limit
of repetitions; one aggregation evaluates 31 exponents and so settles five binary digits.

The weights are realised exactly to the token budget. An epoch of a source is a permutation:
a hash of seed, epoch and document deals documents to blocks, blocks follow one another. Full
epochs take all blocks; the last epoch takes whole blocks while they fit, then documents of the
next block, in hash order, while they fit. What the budget needs of a source is therefore six
numbers, and every document decides for itself how often it appears; no source is ever
gathered in one task. Block sums are combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import ContractError
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SEED = 2026
DIGITS, PASSES = 5, 6  # binary digits of the exponent settled by one aggregation; aggregations


def token_count(text: Column) -> Column:
    """White-space separated words; every document counts at least one."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    """A null source is the source with the empty name."""
    return F.coalesce(source.cast("string"), F.lit(""))


def draw(epoch: Column, id_text: Column) -> Column:
    """A uniform 32-bit number of seed, epoch and document."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), id_text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _id_text(id_column: Column) -> Column:
    return F.coalesce(id_column.cast("string"), F.lit(""))


def _block(u: Column, n_blocks: Column) -> Column:
    return F.shiftright(u * n_blocks, 32)


def _measures(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Per exponent the entropy of the weights and the largest ratio of weight to token share."""
    grid = sources.select("share", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("alpha"))
    p = F.pow("share", "alpha")
    rows = grid.groupBy("alpha").agg(
        F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("plogp"), F.max(p / F.col("share")).alias("top")
    ).collect()
    return {r["alpha"]: (-(r["plogp"] / r["z"]) + math.log(r["z"]), r["top"] / r["z"]) for r in rows}


def find_exponent(sources: DataFrame, *, entropy_share: float | None, max_repeats: float | None, budget_ratio: float | None) -> float:
    """The smallest exponent on the grid of 2**-30 that meets both limits; ``sources(share)``.

    Entropy and repetitions both fall as the exponent grows, so this is the flattest mixture
    whose entropy does not exceed the target and that repeats no source more often than
    ``max_repeats``; exponent 1, the corpus, is the last resort. ``entropy_share`` places the
    target entropy between the corpus (0) and equal weights (1). ``budget_ratio`` is the budget
    over the corpus, or None for the smallest budget that keeps all documents.
    """
    ends = _measures(sources, [0.0, 1.0])
    target = None
    if entropy_share is not None:
        target = ends[1.0][0] + entropy_share * (ends[0.0][0] - ends[1.0][0])

    def repeats(alpha: float, top: float) -> float:
        return top * (budget_ratio if budget_ratio is not None else keep_all[alpha])

    def accepted(alpha: float, measured: tuple[float, float]) -> bool:
        """True where the exponent is large enough: entropy at or below the target, repeats within the limit."""
        entropy, top = measured
        flat = target is None or entropy <= target
        return flat and (max_repeats is None or repeats(alpha, top) <= max_repeats)

    keep_all: dict[float, float] = {}

    def measure(exponents: list[float]) -> dict[float, tuple[float, float]]:
        if budget_ratio is None:
            grid = sources.select("share", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("alpha"))
            p = F.pow("share", "alpha")
            for r in grid.groupBy("alpha").agg((F.max(F.col("share") / p) * F.sum(p)).alias("ratio")).collect():
                keep_all[r["alpha"]] = r["ratio"]
        return _measures(sources, exponents)

    low, width = 0.0, 1.0  # the answer is in [low, low + width]
    if accepted(0.0, measure([0.0])[0.0]):
        return 0.0
    for _ in range(PASSES):
        step = width / (1 << DIGITS)
        grid = [low + i * step for i in range(1, 1 << DIGITS)]
        found = measure(grid)
        low = max([low, *[a for a in grid if not accepted(a, found[a])]])
        width = step
    return low + width


def mixture_plan(
    counted: DataFrame, *, entropy_share: float | None = 0.5, max_repeats: float | None = None, budget_tokens: int | None = None,
    block_tokens: int = 100_000, keep_all: bool = False,
) -> DataFrame:
    """One row per source of ``counted(doc_id, source, n_tokens)``; what ``realise`` needs to know.

    Columns: source, tokens, weight, budget, full_epochs, n_blocks, cut_block, cut_u, cut_id.
    The budget is ``budget_tokens``, or with ``keep_all`` the smallest at which every document
    appears, or else as many tokens as the corpus has.
    """
    if entropy_share is None and max_repeats is None:
        raise ContractError("give a target entropy or a limit of repetitions")
    counted = counted.select(source_key(F.col("source")).alias("source"), _id_text(F.col("doc_id")).alias("id"), "n_tokens")
    sources = materialize(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0]
    if total is None:
        return sources.select(
            "source", "tokens", F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("budget", "full_epochs", "n_blocks", "cut_block", "cut_u")],
            F.lit("").alias("cut_id"),
        )
    shares = materialize(sources.withColumn("share", F.col("tokens") / F.lit(float(total))))
    ratio = None if keep_all else (budget_tokens or total) / total
    alpha = find_exponent(shares, entropy_share=entropy_share, max_repeats=max_repeats, budget_ratio=ratio)
    z = shares.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0]
    # Rounding makes weights, and so budgets, independent of the order of the sum.
    weighted = shares.withColumn("weight", F.greatest(F.round(F.pow("share", F.lit(alpha)) / z, 12), F.lit(1e-12)))
    if keep_all:
        budget_tokens = weighted.agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0]
    wanted = F.floor(F.col("weight") * float(budget_tokens or total)).cast("long")
    planned = (
        weighted.withColumn("budget", F.greatest(wanted, F.col("tokens")) if keep_all else wanted)
        .withColumn("full_epochs", F.expr("budget div tokens"))
        .withColumn("left", F.expr("budget % tokens"))
        .withColumn("n_blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
    )
    planned = materialize(planned.select("source", "tokens", "weight", "budget", "full_epochs", "left", "n_blocks"))
    last = counted.join(planned.select("source", "full_epochs", "left", "n_blocks"), "source").withColumn("u", draw(F.col("full_epochs"), F.col("id")))
    last = last.withColumn("block", _block(F.col("u"), F.col("n_blocks")))
    sums = last.groupBy("source", "left", "block").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("block"))
    cut = materialize(
        sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
        .groupBy("source").agg(F.min(F.struct("block", (F.col("left") - F.col("upto") + F.col("n")).alias("room"))).alias("c"))
        .select("source", F.col("c.block").alias("cut_block"), F.col("c.room").alias("room"))
    )
    inside = last.join(cut, "source").filter(F.col("block") == F.col("cut_block")).groupBy("source", "room", "u", "id").agg(F.sum("n_tokens").alias("n"))
    taken = F.sum("n").over(Window.partitionBy("source").orderBy("u", "id"))
    fits = (
        inside.withColumn("taken", taken).filter(F.col("taken") <= F.col("room"))
        .groupBy("source").agg(F.max(F.struct("u", "id")).alias("t"))
    )
    return materialize(
        planned.drop("left").join(cut.drop("room"), "source").join(fits, "source", "left")
        .withColumn("cut_u", F.coalesce("t.u", F.lit(-1).cast("long"))).withColumn("cut_id", F.coalesce("t.id", F.lit(""))).drop("t")
    )


def realise(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with one row per appearance in the mixture, and the columns mix_epoch and mix_block.

    Sorting by (mix_epoch, mix_block) gives each source's permutation. Documents of a source
    outside the plan do not appear. The plan has one row per source; it is joined by whatever
    way its real size allows.
    """
    mine = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "full_epochs", "n_blocks", "cut_block", "cut_u", "cut_id")])
    rows = docs.join(mine, source_key(F.col(source_col)) == F.col("_mix_source")).withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_full_epochs")))
    )
    text_id = _id_text(F.col(id_col))
    rows = rows.withColumn("_mix_u", draw(F.col("mix_epoch"), text_id)).withColumn("mix_block", _block(F.col("_mix_u"), F.col("_mix_n_blocks")))
    before = F.struct(F.col("_mix_u"), text_id) <= F.struct(F.col("_mix_cut_u"), F.col("_mix_cut_id"))
    shown = (
        (F.col("mix_epoch") < F.col("_mix_full_epochs")) | (F.col("mix_block") < F.col("_mix_cut_block"))
        | ((F.col("mix_block") == F.col("_mix_cut_block")) & before)
    )
    kept = rows.filter(shown)
    return kept.drop(*[c for c in kept.columns if c.startswith("_mix_")])


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, n_tokens)``, written once: the only pass over the texts."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("n_tokens")))
