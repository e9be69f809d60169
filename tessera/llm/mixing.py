"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The token shares of the sources are raised to an exponent and normalised.  The exponent is
the largest in 0..1 (1 keeps the shares, 0 makes them equal) whose entropy reaches the target;
where a source would then be repeated more often than allowed, it is moved to the least
exponent that respects the limit.  Both are found by bisection; every round is one aggregation
over the source table for ``WAYS`` exponents at once, so the sources need not fit the driver.

Each source gets its weight of the token budget.  Whole passes over a source take all of its
documents.  The rest takes a prefix of a fixed random order: documents fall into blocks by a hash,
blocks are permuted, documents are permuted inside their block, and running token sums, first over
blocks and then inside the block where the budget ends, tell where the prefix stops.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and come
with the passes whose prefix they stand in; rows without id, and ties of the order, go by tokens;
repeated rows are counted as often as they occur; an empty table, or one without tokens, has
copies 0 or 1 as its passes say (1 where nothing has tokens); texts count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import renamed, table
from tessera.plans.scratch import materialize

#: Target entropy as a share of the greatest, and passes over a source at most.
EVENNESS, REPEATS = 0.95, 4.0
#: Documents a block should hold.
BLOCK = 4096
WAYS, ROUNDS = 32, 6


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def moments(shares: DataFrame, budget_over_total: float | None, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, most passes over any source) for each exponent; ``shares`` has a positive ``p`` for each source.

    Without a budget every source is passed over once at least, so passes are relative to the fewest.
    """
    a = F.explode(F.array(*[F.lit(float(x)) for x in exponents]))
    rows = shares.select("p", a.alias("a")).withColumn("q", F.pow("p", F.col("a")))
    got = rows.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("a") * F.log("p")).alias("m"), F.max(F.col("q") / F.col("p")).alias("r"), F.min(F.col("q") / F.col("p")).alias("least")).collect()
    by = {r.a: (math.log(r.z) - r.m / r.z, r.r / r.least if budget_over_total is None else budget_over_total * r.r / r.z) for r in got}
    return [by[float(x)] for x in exponents]


def find_exponent(shares: DataFrame, budget_over_total: float | None, evenness: float, repeats: float) -> float:
    """The exponent in 0..1; entropy falls and, with it, so do the passes over small sources as it grows."""
    greatest = math.log(max(1, shares.count()))

    def last(holds) -> float:
        """Greatest exponent of 0..1 for which ``holds``; 0 if there is none."""
        lo, hi = 0.0, 1.0
        if holds(*moments(shares, budget_over_total, [1.0])[0]):
            return 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / WAYS for i in range(1, WAYS)]
            ok = [holds(*m) for m in moments(shares, budget_over_total, grid)]
            n = sum(ok)
            lo, hi = (grid[n - 1] if n else lo), (grid[n] if n < len(grid) else hi)
        return lo

    even = last(lambda h, r: h >= evenness * greatest - 1e-12)
    if moments(shares, budget_over_total, [even])[0][1] <= repeats:
        return even
    return min(1.0, last(lambda h, r: r > repeats) + 32.0**-ROUNDS)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    evenness: float = EVENNESS,
    repeats: float = REPEATS,
    budget: float | None = None,
    seed: int = 1,
    tokens=word_count,
    whole: bool = False,
) -> DataFrame:
    """(id, source, n_tokens, weight, copies, block, place, block_rank, begin) for every row; the default budget is the corpus's tokens.

    The order of a source is by ``block_rank``, the block's rank in the permutation, then by place, id and tokens;
    ``begin`` counts the tokens before the row in it, so a reader can replay the order or any part of it.  With ``whole`` the budget is the least that passes over every source once, so every row has a copy.
    """
    rows = renamed(docs, id=id_col, source=source_col, text=text_col).withColumn("n_tokens", tokens(F.col("text"))).drop("text")
    rows = materialize(rows, "mix-rows")
    sources = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    shares = materialize(sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total or 1))), "mix-shares")
    a = find_exponent(shares, None if whole else budget / total, evenness, repeats) if total else 1.0
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    z = z or 1.0
    if whole and total:
        budget = total * z / least
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(float(z))
    passes = F.when(F.col("tokens") > 0, F.lit(budget) * weight / F.col("tokens")).otherwise(F.lit(1.0))
    aims = sources.select(
        F.col("source").alias("s"),
        F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)).alias("weight"),
        F.floor(passes + 1e-9).alias("full"),
        (F.greatest(passes - F.floor(passes + 1e-9), F.lit(0.0)) * F.col("tokens")).alias("rest"),
        (F.floor(F.col("n") / BLOCK) + 1).alias("blocks"),
    )
    aims = materialize(aims, "mix-aims")
    dealt = rows.join(aims, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")))
    dealt = dealt.withColumn("place", F.xxhash64(F.lit(seed + 1), "id", "block"))
    # where each block begins in its source's permuted order
    by_block = dealt.groupBy("s", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 2), "block"), "block")
    begins = by_block.select(F.col("s").alias("bs"), F.col("block").alias("bb"), (F.sum("block_tokens").over(order) - F.col("block_tokens")).alias("block_begin"), F.row_number().over(order).cast("long").alias("block_rank"))
    inside = Window.partitionBy("s", "block").orderBy("place", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("upto", F.sum("n_tokens").over(inside))
    run = run.join(materialize(begins, "mix-blocks"), F.col("s").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    extra = (F.col("block_begin") + F.col("upto") <= F.col("rest") + 1e-6) & (F.col("rest") > 0)
    return run.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "weight", (F.col("full") + extra.cast("long")).alias("copies"), "block", "place", "block_rank", (F.col("block_begin") + F.col("upto") - F.col("n_tokens")).alias("begin"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
