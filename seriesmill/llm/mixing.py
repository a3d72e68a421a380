"""Temperature mixing of sources.

A source's weight is its share of all tokens (words) to the power alpha, normalised.
Alpha starts at 1 (shares as they are) and is bisected down until the weights reach a
target entropy, as far as no source would be repeated more often than a limit allows;
the midpoints that the next LEVELS halvings can meet are tried in one aggregate over the
sources, so their number is not bounded by the driver. A source's part of the token budget is
realised as block permutations: whole passes over the source, each in an order of its
own (by hash), and the start of one more, up to the budget. `at`, a row's place in its
source's budget from 0 to 1, orders the mixture with all sources interleaved.

Ranks come from prefix sums over hash ranges of some ROWS rows, then within them; a
source with a third of all rows has as many ranges as it needs.

Defined results: a null source is a source of its own; a null or empty text has no
words and costs nothing; a source without words gets one pass; rows that are equal in
doc_id, source and text follow each other as one unit, so repeated rows stay repeated;
equal hashes are ordered by doc_id, then by text hash; a very long text is one unit, and
in the pass that is not whole it goes where it would pass the budget; an empty table
gives no rows; `mix` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import columns_of, cut, hot_bins, join_salted, whole_row

#: Halvings of the exponent's interval whose midpoints one aggregate tries, and how many such steps.
LEVELS, STEPS = 5, 7
ROWS = 4_000
ENTROPY = 0.97
REPEATS = 4.0
SEED = 42


@dataclass(frozen=True)
class Mixture:
    """alpha, the sum of the powers, and the token budget."""

    alpha: float
    norm: float
    budget: float
    total: float


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def choose(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | str = 1.0) -> Mixture:
    """sources (tokens long), one row each -> Mixture.

    entropy: the target as a share of its maximum, ln(number of sources). budget: in
    units of all tokens, or "cover": the least budget that takes every source whole.
    """
    live = sources.where("tokens > 0")
    count, total, most = live.agg(F.count("*"), F.sum("tokens"), F.max("tokens")).first()
    if not count:
        return Mixture(1.0, 1.0, 0.0, 0.0)
    target = entropy * math.log(count)
    share = F.col("tokens") / F.lit(float(total))

    def moments(alphas: list[float]) -> dict[float, tuple[float, float, float]]:
        """alpha -> entropy of the weights, most repeats of a source, sum of powers."""
        rows = live.select(F.explode(F.array(*map(F.lit, alphas))).alias("a"), share.alias("p")).groupBy("a").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.ln("p")).alias("s"), F.min("p").alias("p"))
        out = {}
        for a, z, s, p in rows.collect():  # one row for each alpha
            size = float(budget) if budget != "cover" else (most / total) ** (1 - a) * z
            out[a] = math.log(z) - a * s / z, size * p ** (a - 1) / z, z
        return out

    # Entropy falls and repeats fall as alpha grows: bisect for the largest alpha with enough entropy and for the smallest within the limit.
    tests = {"entropy": lambda m: m[0] >= target - 1e-12, "repeats": lambda m: m[1] > repeats + 1e-12}  # true: alpha may grow, or must
    ends = {k: (0.0, 1.0) for k in tests}
    edge = moments([0.0, 1.0])
    ends = {"entropy": (1.0, 1.0) if tests["entropy"](edge[1.0]) else (0.0, 1.0), "repeats": (0.0, 1.0) if tests["repeats"](edge[0.0]) else (0.0, 0.0)}
    for _ in range(STEPS):
        points = {k: [lo + (hi - lo) * i / 2**LEVELS for i in range(2**LEVELS + 1)] for k, (lo, hi) in ends.items()}
        found = moments(sorted({a for x in points.values() for a in x}))
        for k, grid in points.items():
            low, high = 0, 2**LEVELS
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if tests[k](found[grid[middle]]) else (low, middle)
            ends[k] = grid[low], grid[high]
    alpha = max(ends["entropy"][0], ends["repeats"][1])
    z = moments([alpha])[alpha][2]
    return Mixture(alpha, z, total * (float(budget) if budget != "cover" else (most / total) ** (1 - alpha) * z), float(total))


def schedule(units: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | str = 1.0, seed: int = SEED) -> DataFrame:
    """units (doc_id, source, text_hash, copies, tokens) -> these, pass, start, at: every unit of each pass within the budget.

    tokens are those of one copy; start counts the tokens before it in its pass.
    """
    units = cut(units)
    sources = units.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("units"))
    sources = cut(sources)
    m = choose(sources, entropy, repeats, budget)
    part = F.when(F.col("tokens") > 0, F.lit(m.budget) * F.pow(F.col("tokens") / F.lit(m.total or 1.0), F.lit(m.alpha)) / F.lit(m.norm)).otherwise(0.0)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("part") / F.col("tokens") + 1e-9)).otherwise(1).cast("int")
    plan = sources.withColumn("part", part).withColumn("whole", whole).select(
        F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), "part", "whole", F.greatest(F.lit(0.0), F.col("part") - F.col("whole") * F.col("tokens")).alias("rest"), F.ceil(F.col("units") / ROWS).alias("ranges"),
    )
    # As an array a null source equals itself.
    each = join_salted(units.withColumn("k", F.array("source")), plan.withColumn("k", F.array("s")), ["k"]).drop("k", "s")
    # The pass that is not whole needs its rows only where some budget is left for it.
    last = F.when(F.col("rest") >= 1, F.col("whole")).otherwise(F.col("whole") - 1)
    each = each.where(last >= 0).withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    key = F.xxhash64(F.lit(seed), "pass", "doc_id", "text_hash")
    # The upper 32 bits of the key, as a share, give the range; ranges follow the order of the key.
    upper = F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 32)
    each = cut(each.withColumn("key", key).withColumn("range", F.floor(upper * F.col("ranges") / F.lit(2.0**32)).cast("long")).withColumn("cost", F.col("tokens") * F.col("copies")))
    sums = each.groupBy("source", "pass", "range").agg(F.sum("cost").alias("total"))
    before = Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("pass").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "range").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("cost").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("range") == F.col("r")))
    placed = placed.withColumn("start", F.col("before") + F.col("inside"))
    taken = placed.where((F.col("pass") < F.col("whole")) | (F.col("start") + F.col("cost") <= F.col("rest")))
    at = F.when(F.col("part") > 0, (F.col("pass") * F.col("source_tokens") + F.col("start")) / F.col("part")).otherwise(0.0)
    return taken.select("doc_id", "source", "text_hash", "copies", "tokens", "pass", "start", at.alias("at"))


def units_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("tokens")).agg(F.count("*").alias("copies"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | str = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, with all their columns."""
    key = [F.array("doc_id").alias("a"), F.array("source").alias("b")]  # as arrays nulls equal themselves
    plan = schedule(units_of(docs), entropy, repeats, budget, seed).groupBy("doc_id", "source", "text_hash").agg(F.count("*").cast("int").alias("times"))
    plan = plan.select(*key, F.col("text_hash").alias("c"), "times")
    marked = docs.select(*key, F.xxhash64("text").alias("c"), whole_row(docs).alias("row"))
    # Equal ids tell where equal rows may be, without another reading of the texts.
    salted = hot_bins(docs.select(F.array("doc_id").alias("a")), ["a"])
    joined = join_salted(marked, plan, ["a", "b", "c"], hot=salted, by=["a"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*columns_of(docs))
