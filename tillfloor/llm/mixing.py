"""Mixing sources to target weights: tempered shares, found by bisection, realised exactly in tokens.

A source's weight is its share of tokens to the power of an exponent, normalised. Lower
exponents are flatter: entropy rises and small sources repeat more. The exponent is bisected to the largest one
whose entropy reaches `entropy` times that of equal weights, and raised to the smallest one at which no
source with a positive share repeats more than `repeats` times. Every evaluation is one
grouped sum over the sources, so there may be any number of them.

A source's budget is its weight times `budget` tokens (all tokens, unless given). It is realised as whole passes over the source
and one partial pass. The partial pass takes documents in a fixed random order: about root-of-n blocks of
about root-of-n documents, blocks in permuted order, documents permuted within. A document is in it
while the tokens before it stay under what the budget asks for, so a source
misses its budget by less than one document. Only block totals are summed across a source; a hot
source is many blocks.

Rows with a null source form one source. Null and empty texts count no tokens and follow their
source's whole passes. Repeated rows are further documents. An empty table gives an empty
result; a corpus without tokens is returned as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillfloor.llm.common import stage

STEPS = 40


def token_counts(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """source_, tokens_ (words) and the two hashes of the order, beside all columns of docs."""
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    return docs.withColumns({
        "source_": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")),
        "tokens_": F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        # 128 bits, so that different rows do not count as copies of each other
        "order_": F.struct(
            F.xxhash64(F.lit(17), *hashed).alias("a"), F.xxhash64(F.lit(18), *reversed(hashed)).alias("b")
        ),
    })


def mix_at(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(normaliser, entropy, largest weight over share) at each exponent; shares is (source_, share)."""
    sums = []
    for e in exponents:
        w = F.pow("share", F.lit(e))
        sums += [F.sum(w), F.sum(w * F.log(w)), F.max(w / F.col("share"))]
    row = shares.agg(*(x.alias(f"x{i}") for i, x in enumerate(sums))).first()
    out = []
    for i in range(len(exponents)):
        z, wlogw, most = row[3 * i : 3 * i + 3]
        out.append((z, math.log(z) - wlogw / z, most / z))
    return out


def find_exponent(shares: DataFrame, n: int, entropy: float, repeats: float, passes: float) -> float:
    """The exponent in 0 to 1. `passes` is budget over tokens. Four bisections in each grouped sum."""

    def search(good) -> tuple[float, float]:
        """(last bad, first good) of a property that holds from some exponent on, or not at all."""
        low, high = 0.0, 1.0
        for _ in range(STEPS // 4):
            grid = [low + (high - low) * i / 16 for i in range(1, 16)]
            values = [low, *grid, high]
            told = [good(x) for x in mix_at(shares, values)]
            if told[0]:
                return low, low
            at = next((i for i, ok in enumerate(told) if ok), len(values) - 1)
            low, high = values[at - 1], values[at]
        return low, high

    if n < 2:
        return 1.0
    goal = entropy * math.log(n)
    # entropy falls as the exponent rises: the largest exponent before it drops below the goal
    flat, _ = search(lambda x: x[1] < goal)
    flat = 1.0 if mix_at(shares, [1.0])[0][1] >= goal else flat
    _, held = search(lambda x: x[2] * passes <= repeats)
    return max(flat, held)


def weights(totals: DataFrame, entropy: float, repeats: float, budget: float | None) -> DataFrame | None:
    """(source_, share, weight, repeat) of the sources with tokens; None where no source has any."""
    n, tokens = totals.filter("tokens > 0").agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return None
    shares = stage(totals.filter("tokens > 0").select("source_", (F.col("tokens") / F.lit(tokens)).alias("share")))
    passes = (budget if budget is not None else tokens) / tokens
    exponent = find_exponent(shares, n, entropy, repeats, passes)
    z = mix_at(shares, [exponent])[0][0]
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    return shares.withColumn("weight", weight).withColumn("repeat", F.col("weight") * F.lit(passes) / F.col("share"))


def mix(
    docs: DataFrame, entropy: float = 0.95, repeats: float = 2.0, budget: float | None = None,
    source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(docs as often as they are to be read, the weights). Columns of docs are kept as they are."""
    columns = docs.columns
    rows = token_counts(docs, source_col, text_col)
    totals = stage(rows.groupBy("source_").agg(F.sum("tokens_").alias("tokens"), F.count("*").alias("docs")))
    chosen = weights(totals, entropy, repeats, budget)
    if chosen is None:
        return docs, totals.selectExpr("source_", "0.0D share", "0.0D weight", "1.0D repeat")
    chosen = stage(chosen)
    plan = totals.join(chosen, "source_", "left").select(
        "source_",
        F.coalesce(F.floor(F.col("repeat") + 1e-9), F.lit(1)).cast("int").alias("whole_"),
        # of the partial pass, in tokens
        F.coalesce(F.greatest(F.col("repeat") - F.floor(F.col("repeat") + 1e-9), F.lit(0.0)) * F.col("tokens"), F.lit(0.0)).alias("part_"),
        F.greatest(F.ceil(F.sqrt("docs")), F.lit(1)).alias("blocks_"),
    )
    plan = stage(plan)
    dealt = rows.join(plan, "source_").withColumn("block_", _block())
    # narrow from here: the order needs hashes and counts only; rows with one hash are one run of copies
    light = stage(dealt.groupBy("source_", "block_", "order_").agg(F.sum("tokens_").alias("t"), F.count("*").alias("copies")))
    blocks = light.groupBy("source_", "block_").agg(F.sum("t").alias("t"))
    before_block = Window.partitionBy("source_").orderBy(F.xxhash64("source_", "block_"), "block_").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select("source_", "block_", F.coalesce(F.sum("t").over(before_block), F.lit(0)).alias("start_"))
    within = Window.partitionBy("source_", "block_").orderBy("order_").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.withColumn("ahead_", F.coalesce(F.sum("t").over(within), F.lit(0)))
    placed = sums.join(starts, ["source_", "block_"]).join(plan.select("source_", "whole_", "part_"), "source_")
    # equal rows follow each other: as many of them are read once more as begin below the budget
    each = F.greatest(F.col("t") / F.col("copies"), F.lit(1e-9))
    more = F.least(
        F.greatest(F.ceil((F.col("part_") - F.col("start_") - F.col("ahead_")) / each), F.lit(0)), F.col("copies")
    )
    more = F.when(F.col("t") > 0, more).otherwise(0)
    counted = placed.select("source_", "block_", "order_", "t", "copies", more.cast("long").alias("more_"))
    # within a block all copies are read again up to some place, at most one run of copies in part, and none behind it
    split = (F.col("more_") > 0) & (F.col("more_") < F.col("copies"))
    cuts = stage(counted.groupBy("source_", "block_").agg(
        F.max(F.when((F.col("t") > 0) & (F.col("more_") == F.col("copies")), F.col("order_"))).alias("again_to_"),
        F.max(F.when(split, F.struct("order_", "copies", "more_"))).alias("split_"),
    ))
    return _read(rows, plan, cuts).select(columns), chosen


def _read(rows: DataFrame, plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each row as often as it is to be read: no row is shuffled but for those of a run that is read in part.

    Such rows are equal in every column and stand for each other.
    """
    placed = (
        rows.join(plan.select("source_", "whole_", "blocks_"), "source_")
        .withColumn("block_", _block())
        .join(cuts, ["source_", "block_"])
    )
    in_part = F.coalesce(F.col("order_") == F.col("split_.order_"), F.lit(False))
    again = F.coalesce((F.col("tokens_") > 0) & (F.col("order_") <= F.col("again_to_")), F.lit(False))
    out = placed.filter(~in_part).withColumn("times_", F.col("whole_") + again.cast("int"))
    if cuts.filter("split_ is not null").isEmpty():
        return _repeated(out)
    one = placed.filter(in_part).dropDuplicates(["source_", "block_", "order_"])
    one = one.withColumn("times_", (F.col("whole_") * F.col("split_.copies") + F.col("split_.more_")).cast("int"))
    return _repeated(out.union(one))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.filter("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))


def _block():
    return F.pmod(F.xxhash64("order_", F.lit(5)), F.col("blocks_"))
