"""Mixing sources to target weights.

*Temperature mixing*: a source's weight is its share of all tokens to the power of an exponent, normalised.
At 1 the mixture is the corpus, at 0 it is uniform. The exponent is found by sectioning an interval (16 parts a
step, which a single aggregate over the sources' totals evaluates) as the largest whose entropy meets
a target, then raised until no source repeats more often than a limit.

*Budgeted block permutations*: each source's documents are dealt into blocks by hash. An epoch of a
source is a permutation of its blocks; a source runs whole epochs and a part of one more, cut where its
token budget ends. The cut is found from sums over bins of the permutation, then blocks of one bin,
then documents of one block, so no source is ever sorted as a whole. Every pick has a position
between 0 and 1 in the mixture; in that order sources come evenly, at their weights.

All of it is DataFrame operations; nothing that grows with the corpus or the number of sources goes
to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import folders
from tesserae.llm.common import FILE, ROW, anchored, located, partitions, rows_of, stored, text_of

#: Bins of a permutation, and parts of a step of the search.
BINS, PARTS, STEPS = 4096, 16, 6
#: Keys that a source's rows are spread over where they meet its plan, at least; as many as a shuffle has partitions, if these are more.
SALTS = 64


@dataclass(frozen=True)
class Settings:
    """entropy: target as a share of the entropy of a uniform mixture. repeats: epochs of a source, at most. budget: tokens of the mixture; None is as many as the corpus has. block_tokens: of a block, on average."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 16
    block_docs: int = 1 << 12
    seed: int = 11


def tokens() -> Column:
    """Words of a text: runs of anything but white space."""
    return F.regexp_count(text_of(), F.lit(r"\S+")).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, _file, _row, source (null: a source of its own) and n_tokens of every whole text, stored."""
    return stored(located(docs, "doc_id", "source", "text").select("doc_id", FILE, ROW, "source", tokens().alias("n_tokens")), "mix-counted")


def _fraction(*key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) * F.lit(2.0**-53)


def exponent(totals: DataFrame, s: Settings) -> float:
    """The exponent for sources' totals (source, tokens)."""
    known = totals.where("tokens > 0")
    all_tokens, n, least = known.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens")).first()
    if not n:
        return 1.0
    budget = s.budget if s.budget is not None else all_tokens
    if budget > s.repeats * all_tokens * (1 + 1e-9):
        raise ValueError(f"{budget} tokens repeat {all_tokens} more than {s.repeats} times")
    log_p = F.log(F.col("tokens") / F.lit(float(all_tokens)))
    low_p = math.log(least / all_tokens)

    def section(good) -> float:
        """good(z, entropy, exponent) changes once between 0 and 1; returns the end where it holds, which is 0's."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            at = [low + (high - low) * i / PARTS for i in range(1, PARTS)]
            sums = known.agg(*[F.sum(F.exp(log_p * a)) for a in at], *[F.sum(F.exp(log_p * a) * log_p * a) for a in at]).first()
            holds = [good(sums[i], math.log(sums[i]) - sums[i + len(at)] / sums[i], a) for i, a in enumerate(at)]
            k = next((i for i, x in enumerate(holds) if not x), len(at))
            low, high = ([low, *at][k], [*at, high][k])
        return low

    # of sources, the one with the fewest tokens repeats most often
    repeats = lambda z, a: budget * math.exp(low_p * a) / z / least
    wanted = s.entropy * math.log(n)
    z1, e1 = known.agg(F.sum(F.exp(log_p)), F.sum(F.exp(log_p) * log_p)).first()
    a = 1.0 if math.log(z1) - e1 / z1 >= wanted else section(lambda z, h, _: h >= wanted)
    if repeats(known.agg(F.sum(F.exp(log_p * a))).first()[0], a) > s.repeats:
        a = 1.0 if repeats(z1, 1.0) >= s.repeats else section(lambda z, _, x: repeats(z, x) > s.repeats) + 1.0 / PARTS**STEPS
    return a


def weigh(totals: DataFrame, s: Settings) -> DataFrame:
    """source, tokens, weight (they add up to 1; sources without a token have 0) and quota (tokens of the mixture)."""
    a = exponent(totals, s)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    sums = totals.agg(F.sum(power).alias("z"), F.sum("tokens").alias("all_tokens"))  # one row
    z, all_tokens = sums.first()
    budget = s.budget if s.budget is not None else (all_tokens or 0)
    weight = power / F.lit(float(z or 1.0))
    return totals.select("source", "tokens", weight.alias("weight"), (weight * F.lit(float(budget))).alias("quota"))


def picks(rows: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The mixture of counted rows (see ``counted``).

    Returns doc_id, _file, _row, source, n_tokens, epoch, block, position, one row for each time that a row is picked.
    A source's picks have quota tokens at most, and fewer by less than one document. Documents
    without a token go with their block. A null source is a source of its own; rows with null or repeated
    doc_ids are told apart by locator. An empty table gives an empty mixture.
    """
    folders.top(rows.sparkSession)
    salts = max(SALTS, partitions(rows.sparkSession))
    seed = F.lit(s.seed)
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).checkpoint()
    plan = weigh(totals.select("source", "tokens"), s).join(totals.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = plan.where("tokens > 0").select(
        F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().alias("no_source"), "quota", "tokens",
        F.floor(F.col("quota") / F.col("tokens") + 1e-9).alias("whole"), (F.col("quota") / F.col("tokens")).alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / s.block_tokens), F.ceil(F.col("docs") / s.block_docs)).alias("n_blocks"),
    ).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")).checkpoint()
    key = ["name", "no_source"]
    dealt = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull())
    # a source may hold a third of all rows: its rows meet its plan under many keys
    own = plan.select(*key, "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(F.col(ROW), F.col(FILE)), F.lit(salts)).cast("int")).join(own, [*key, "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(seed, F.col(FILE), F.col(ROW)), F.col("n_blocks"))).drop("n_blocks", "salt")
    blocks = dealt.groupBy(*key, "block").agg(F.sum("n_tokens").alias("tokens")).join(plan.drop("tokens", "n_blocks"), key)
    place = _fraction(seed, F.col("name"), F.col("no_source"), F.col("whole"), F.col("block"))
    blocks = blocks.withColumn("place", place).withColumn("bin", F.floor(F.col("place") * BINS)).checkpoint()
    # of the part epoch: bins, then blocks of the bin with the cut, then documents of the block with it
    bins = blocks.groupBy(*key, "bin").agg(F.sum("tokens").alias("in_bin"))
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before_bin", before)
    blocks = blocks.join(bins, [*key, "bin"])
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy(*key, "bin").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_bin = blocks.where("before_bin <= rest AND before_bin + in_bin > rest").withColumn("before", F.col("before_bin") + inside)
    other = blocks.where("NOT (before_bin <= rest AND before_bin + in_bin > rest)").withColumn("before", F.col("before_bin"))
    blocks = cut_bin.unionByName(other).withColumn("left", F.col("rest") - F.col("before"))
    blocks = blocks.withColumn("all", (F.col("left") > 0) & (F.col("tokens") <= F.col("left"))).withColumn("some", (F.col("left") > 0) & (F.col("tokens") > F.col("left")) & (F.col("before_bin") <= F.col("rest")))
    # bins after the cut start beyond it; bins before it end before it, so all of their blocks are in
    blocks = blocks.withColumn("all", F.when(F.col("before_bin") + F.col("in_bin") <= F.col("rest"), True).otherwise(F.col("all")))
    chosen = dealt.join(blocks.select(*key, "block", "whole", "epochs", "all", "some", "left", "place"), [*key, "block"])
    order = Window.partitionBy(*key, "block").orderBy(F.xxhash64(seed, F.col("whole"), F.col(FILE), F.col(ROW)), FILE, ROW)
    part = chosen.where("some").withColumn("last", F.sum("n_tokens").over(order) <= F.col("left"))
    rest = chosen.where("NOT some").withColumn("last", F.col("all"))
    chosen = part.unionByName(rest)
    epochs = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>")), F.when(F.col("last"), F.array(F.col("whole"))).otherwise(F.array().cast("array<bigint>")))
    out = chosen.withColumn("epoch", F.explode(epochs))
    position = (F.col("epoch") + _fraction(seed, F.col("name"), F.col("no_source"), F.col("epoch"), F.col("block"))) / F.greatest(F.col("epochs"), F.col("epoch") + 1)
    return out.select("doc_id", FILE, ROW, "source", "n_tokens", "epoch", "block", position.alias("position"))


def mixture(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The picks of ``docs`` (see ``picks``)."""
    return picks(counted(anchored(docs)), s)


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` as the mixture has it: rows that are picked more than once are repeated, others may be left out."""
    docs = anchored(docs)
    return rows_of(docs, mixture(docs, s), how="inner")
