"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``alpha``, normalised.  ``alpha`` is bisected
within 0 to ``STEEPEST`` to the target entropy: below 1 where the target lies above the corpus's own entropy,
above 1 where it lies below.  Where some source would then be repeated more than the limit, ``alpha``
is moved towards 1, where repetition is least, until none is.  A target that no ``alpha``
meets leaves a mark in the ``Mix`` (``entropy_met``, ``repetition_met``).  Bisection needs two sums over
the sources for each ``alpha``, so sources stay in a table, however many there are.

Weights are realised by permutations of blocks.  Documents fall into ``BLOCKS`` hash blocks a
source; each pass over a source takes its blocks in an order of its own, that of a hash seeded
with the number of the pass.  A source with a budget of ``t`` tokens and a size of ``T`` gets ``t // T`` whole passes
and, of the next permutation, the blocks up to the remainder; the block at the edge is cut in
the order of a hash of its documents.  So a source's decision is four numbers, and texts never move.

Defined results: a null source is a source of its own; null and empty texts have no
tokens; a source without tokens is used once; documents of one id go together; no
documents give no rows.  Own columns named like the results are replaced, all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import store

BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: The largest exponent, and how many exponents one round of bisection tries at once.
STEEPEST, TRIES = 32.0, 32
#: A document's place in its block comes from this many upper bits first.
_SUB = 12


@dataclass
class Sizes:
    """What bisection needs of the sources with tokens: their number, their tokens (all, least, most), and for
    some exponents the sums of ``share ** a`` and ``share ** a * ln(share)``."""

    live: int
    total: float
    least: float
    most: float
    sums: Callable[[list[float]], list[tuple[float, float]]]


@dataclass
class Mix:
    """``weight = share ** alpha / norm``."""

    alpha: float
    norm: float
    budget: float
    entropy: float
    repetition: float
    entropy_met: bool = True
    repetition_met: bool = True


def listed(sizes: list[float]) -> Sizes:
    """Sources given as a list of token counts."""
    live = [float(s) for s in sizes if s > 0]
    total = sum(live)
    share = [s / total for s in live]
    return Sizes(len(live), total, min(live, default=0.0), max(live, default=0.0), lambda alphas: [(sum(p**a for p in share), sum(p**a * math.log(p) for p in share)) for a in alphas])


def tabled(sources: DataFrame) -> Sizes:
    """Sources given as a table (source, tokens); a round of bisection is one aggregate."""
    live = sources.where("tokens > 0")
    row = live.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("a"), F.max("tokens").alias("b")).first()
    total = float(row["t"] or 0)

    def sums(alphas: list[float]) -> list[tuple[float, float]]:
        p = F.col("tokens") / F.lit(total or 1.0)
        got = live.agg(*[f(x).alias(f"{n}{i}") for i, a in enumerate(alphas) for n, f, x in (("z", F.sum, F.pow(p, F.lit(a))), ("s", F.sum, F.pow(p, F.lit(a)) * F.log(p)))]).first()
        return [(got[f"z{i}"] or 0.0, got[f"s{i}"] or 0.0) for i in range(len(alphas))]

    return Sizes(row["n"], total, float(row["a"] or 0), float(row["b"] or 0), sums)


def solve(sizes: Sizes, entropy_share: float, max_repetition: float, budget: float | None = None, cover: bool = False, rounds: int = 6) -> Mix:
    """The exponent for these sources.

    The target entropy is ``entropy_share`` times that of equal weights.  ``budget`` is in tokens
    (default: the corpus size); with ``cover`` it is instead the least that uses every source
    once in whole.
    """
    if not sizes.live:
        return Mix(1.0, 1.0, 0.0, 0.0, 0.0)
    target = entropy_share * math.log(sizes.live)
    low_share, high_share = sizes.least / sizes.total, sizes.most / sizes.total

    def at(alpha: float, sums: tuple[float, float]) -> Mix:
        z, s = sums
        ends = [p ** (alpha - 1) / z for p in (low_share, high_share)]  # weight over share, whose extremes are at the extreme shares
        size = sizes.total / min(ends) if cover else float(sizes.total if budget is None else budget)
        return Mix(alpha, z, size, math.log(z) - alpha * s / z, max(ends) * size / sizes.total)

    def last_that(fits: Callable[[Mix], bool], start: float, stop: float) -> Mix:
        """The exponent nearest to ``stop``, from ``start``, that fits, where those near ``start`` do."""
        best = at(start, sizes.sums([start])[0])
        for _ in range(rounds):
            tries = [start + (stop - start) * (i + 1) / TRIES for i in range(TRIES)]
            mixes = [at(a, s) for a, s in zip(tries, sizes.sums(tries), strict=True)]
            n = next((i for i, m in enumerate(mixes) if not fits(m)), len(mixes))
            if n:
                best = mixes[n - 1]
            if n == len(mixes) or abs(stop - start) < 1e-12:
                break
            start, stop = best.alpha, tries[n]
        return best

    # entropy falls as the exponent rises
    mix = last_that(lambda m: m.entropy >= target - 1e-12, 0.0, STEEPEST)
    mix.entropy_met = abs(mix.entropy - target) < 1e-6
    if mix.repetition > max_repetition:
        met = mix.entropy_met
        even = at(1.0, sizes.sums([1.0])[0])
        mix = last_that(lambda m: m.repetition <= max_repetition, 1.0, mix.alpha) if even.repetition <= max_repetition else even
        mix.entropy_met, mix.repetition_met = met and abs(mix.entropy - target) < 1e-6, mix.repetition <= max_repetition
    return mix


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``n_tokens`` of every row, written once."""
    return store.materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")), "token-counts")


def _block(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BLOCKS)).cast("int")


def _place(seed: int, number, source="source", block="block"):
    """A block's place in a pass of its source."""
    return F.xxhash64(F.lit(seed + 1), source, block, number)


def _within(seed: int):
    """A document's place in its block."""
    return F.xxhash64(F.lit(seed + 2), "doc_id")


def _edge(keys: DataFrame) -> DataFrame:
    """Of (source, key, tokens, rest) in order of ``key``: per source the key in which the running sum passes ``rest``, and how much of it is left there."""
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    run = keys.withColumn("upto", F.sum("tokens").over(order)).where("upto > rest")
    return run.groupBy("source").agg(F.min(F.struct("upto", "key", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("e")).select(F.col("source").alias("at_source"), F.col("e.key").alias("cut"), F.col("e.left").alias("left"))


def plan(sizes: DataFrame, entropy_share: float, max_repetition: float, budget: float | None = None, cover: bool = False, seed: int = 17) -> tuple[Mix, DataFrame]:
    """The mix, and per source its weight, whole passes and the cut of the last one (a row a source), from ``measure``'s table."""
    blocks = store.materialise(sizes.groupBy("source", _block(seed).alias("block")).agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = store.materialise(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    known = tabled(sources)
    mix = solve(known, entropy_share, max_repetition, budget, cover)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(known.total or 1.0), F.lit(mix.alpha)) / F.lit(mix.norm)).otherwise(0.0)
    want = F.col("weight") * F.lit(mix.budget)
    passes = F.when(F.col("tokens") > 0, F.floor(want / F.col("tokens") + 1e-9)).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.greatest(F.lit(0), F.floor(want - F.col("passes") * F.col("tokens") + 1e-6))).otherwise(0).cast("long")
    wanted = store.materialise(sources.withColumn("weight", weight).withColumn("passes", passes).withColumn("rest", rest).select(F.col("source").alias("w_source"), "weight", "passes", "rest"), "wanted")
    by_source = F.col("source").eqNullSafe(F.col("w_source"))
    first = store.materialise(_edge(blocks.join(wanted, by_source).select("source", _place(seed, F.col("passes")).alias("key"), "tokens", "rest")), "edges")
    # the documents of one block a source; cut first by the upper bits of their places, then by their places
    cuts = first.join(wanted, F.col("at_source").eqNullSafe(F.col("w_source"))).select("w_source", "passes", "cut", "left")
    inside = sizes.withColumn("block", _block(seed)).join(cuts, by_source & (_place(seed, F.col("passes")) == F.col("cut"))).select("source", _within(seed).alias("place"), "n_tokens", "left")
    inside = store.materialise(inside.withColumn("upper", F.shiftright("place", 64 - _SUB)), "edge-documents")
    second = store.materialise(_edge(inside.groupBy("source", F.col("upper").alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.max("left").alias("rest"))), "edges")
    by_doc = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    least = second.select(F.col("at_source").alias("l_source"), "cut", F.col("left").alias("room"))
    last = inside.join(least, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("upper") == F.col("cut"))).withColumn("upto", F.sum("n_tokens").over(by_doc))
    last = last.where("upto <= room").groupBy("source").agg(F.max("place").alias("doc_cut")).withColumnRenamed("source", "d_source")
    ends = second.join(last, F.col("at_source").eqNullSafe(F.col("d_source")), "left").select(F.col("at_source").alias("d_source"), F.coalesce("doc_cut", F.shiftleft("cut", 64 - _SUB) - 1).alias("doc_cut"))
    out = wanted.join(first.select("at_source", F.col("cut").alias("block_cut")), F.col("w_source").eqNullSafe(F.col("at_source")), "left").join(ends, F.col("w_source").eqNullSafe(F.col("d_source")), "left")
    return mix, store.materialise(out.select(F.col("w_source").alias("source"), "weight", "passes", "block_cut", "doc_cut"), "mixing-plan")


def assign(docs: DataFrame, plans: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with ``block``, ``weight``, ``copies`` (how often the document is used) and ``places`` (its block's place in each pass that uses it)."""
    base = docs.drop("block", "weight", "copies", "places")
    rows = base.select(F.struct(*base.columns).alias("row"), "doc_id", F.col("source").cast("string").alias("source")).withColumn("block", _block(seed))
    p = plans.withColumnRenamed("source", "plan_source")  # a row a source: Spark broadcasts it if its size allows
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    place = _place(seed, F.col("passes"))
    extra = F.when(place < F.col("block_cut"), 1).when((place == F.col("block_cut")) & (_within(seed) <= F.col("doc_cut")), 1).otherwise(0)
    joined = joined.withColumn("copies", F.coalesce(F.col("passes") + F.when(F.col("block_cut").isNull(), 0).otherwise(extra), F.lit(0)).cast("int"))
    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("places", F.transform(numbers, lambda n: _place(seed, n.cast("long")))).select("row.*", "block", "weight", "copies", "places")


def realise(docs: DataFrame, plans: DataFrame, seed: int = 17, keep_order: bool = False) -> DataFrame:
    """``docs``, each row as often as its source's passes use it; with ``keep_order`` also ``mix_pass`` and ``mix_place``, by which a source's rows are in their passes' orders."""
    rows = assign(docs.select(F.struct(*docs.columns).alias("own"), "doc_id", "source"), plans, seed).where("copies > 0")
    rows = rows.select("own", F.posexplode("places").alias("mix_pass", "mix_place"))
    return rows.select("own.*", "mix_pass", "mix_place") if keep_order else rows.select("own.*")
