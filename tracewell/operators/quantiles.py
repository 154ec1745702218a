"""Exact order statistics that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage, join_dimension

# The sketch is off by at most 1 / accuracy of the rows; brackets allow three times that,
# so by default the first band holds 6 rows in 100,000.
ACCURACY = 100_000
# Different values of a band that are ranked in one window; wider bands are narrowed first.
BAND, SPLIT = 100_000, 4096


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probabilities: dict[str, float],
    method: str = "linear",
    accuracy: int = ACCURACY,
    band: int = BAND,
) -> DataFrame:
    """One column per named probability, exact.

    A mergeable sketch brackets every requested rank; a second pass counts what lies
    below each bracket and keeps, pre-aggregated by value, only the narrow band inside
    it. Groups of up to `accuracy` values, too small for a bracket, use
    their full range. Bands of more than `band` different values are narrowed in rounds of counting
    until what is ranked in one window has a fixed size, at any number of rows. `linear` interpolates between the two closest ranks, `nearest` takes rank
    floor(p * (n - 1) + 0.5).
    """
    values = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    names, slack = list(probabilities), 3 / accuracy
    lows = [max(p - slack, 0.0) for p in probabilities.values()]
    highs = [min(p + slack, 1.0) for p in probabilities.values()]

    def bracket(points: list[float]) -> Column:
        return F.percentile_approx("_v", [float(p) for p in points], accuracy)

    stats = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_v").alias("_max"),
        bracket(lows).alias("_lows"),
        bracket(highs).alias("_highs"),
    )
    small = F.col("_n") <= accuracy
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(p) * (F.col("_n") - 1)).alias("at"),
                F.when(~small & F.lit(lows[i] > 0), F.col("_lows")[i]).alias("low"),
                F.when(small | F.lit(highs[i] == 1), F.col("_max")).otherwise(F.col("_highs")[i]).alias("high"),
            )
            for i, (name, p) in enumerate(probabilities.items())
        ]
    )
    if keys:
        staged = cut_lineage(stats.select(*keys, "_n", F.explode(wanted).alias("_q")))
        most = staged.agg(F.max("_n")).first()[0] or 0
        joined = join_dimension(values, staged.drop("_n"), list(keys), spread=F.xxhash64("_v"), stage=False, largest=most)
    else:  # one scalar bracket per probability
        asked = stats.select("_n", wanted.alias("w")).first()
        most = asked["_n"]
        brackets = [
            F.struct(F.lit(q["name"]).alias("name"), F.lit(q["at"]).alias("at"),
                     F.lit(q["low"]).cast("double").alias("low"), F.lit(q["high"]).alias("high"))
            for q in asked["w"]
        ]
        joined = values.select("_v", F.explode(F.array(*brackets)).alias("_q"))
    banded = (
        joined.where(F.col("_v") <= F.col("_q.high"))
        .withColumn("_band", F.when(F.col("_q.low").isNull() | (F.col("_v") >= F.col("_q.low")), F.col("_v")))
        .groupBy(*keys, F.col("_q.name").alias("_name"), F.col("_q.at").alias("_at"), "_band")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # what a sketch's slack leaves in a band, or a small group whole
    if (most if most <= accuracy else 2 * slack * most) > band:
        banded = narrowed(banded, [*keys, "_name"], band)
    order = Window.partitionBy(*keys, "_name").orderBy(F.col("_band").asc_nulls_first())
    ranked = banded.withColumn("_upto", F.sum("_c").over(order))
    if method == "nearest":
        first = second = F.floor(F.col("_at") + F.lit(0.5))
    else:
        first, second = F.floor("_at"), F.ceil("_at")

    def at_rank(rank: Column) -> Column:
        inside = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(inside, F.col("_band")))

    picked = ranked.groupBy(*keys, "_name").agg(
        at_rank(first).alias("_a"), at_rank(second).alias("_b"), F.first("_at").alias("_at")
    )
    share = F.col("_at") - F.floor("_at") if method == "linear" else F.lit(0.0)
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * share
    checked = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error("rank outside its bracket").cast("double")).otherwise(exact)
    return (
        picked.select(*keys, "_name", checked.alias("_value"))
        .groupBy(*keys)
        .pivot("_name", names)
        .agg(F.first("_value"))
    )


def narrowed(banded: DataFrame, by: list[str], band: int) -> DataFrame:
    """The bands (by, _at, _band, _c) with at most `band` different values, or values too close to part.

    A round counts a band in SPLIT equal steps from its least to its greatest value, finds the steps of
    the two wanted ranks, adds what lies below to the count under the null value and leaves out what
    lies above. Every round keeps two steps of a few thousand, so rounds follow the logarithm.
    """
    before = None
    while True:
        banded = cut_lineage(banded)
        sizes = banded.groupBy(*by).agg(
            F.count("_band").alias("_n"), F.min("_band").alias("_least"), F.max("_band").alias("_most")
        )
        widest = sizes.agg(F.max("_n")).first()[0] or 0
        if widest <= band or widest == before:
            return banded
        before = widest
        # numbers of steps grow with the value, also where rounding makes them uneven
        place = F.floor((F.col("_band") - F.col("_least")) / (F.col("_most") - F.col("_least")) * SPLIT)
        step = F.when(F.col("_n") > band, F.coalesce(place, F.lit(-1))).otherwise(F.lit(0)).cast("int")
        placed = join_dimension(banded, sizes, by, spread=F.xxhash64("_band"), largest=widest).withColumn("_step", step)
        counted = placed.groupBy(*by, "_at", "_step").agg(F.sum("_c").alias("_in"))
        upto = F.sum("_in").over(Window.partitionBy(*by).orderBy("_step"))
        wanted = cut_lineage(counted.withColumn("_upto", upto).groupBy(*by).agg(
            F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("_step"))).alias("_from"),
            F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_step"))).alias("_to"),
        ))
        kept = join_dimension(placed, wanted, by, spread=F.xxhash64("_band"), stage=False, largest=widest)
        inside = F.col("_step") <= F.coalesce("_to", F.lit(SPLIT))
        under = F.when(F.col("_step") >= F.col("_from"), F.col("_band")).alias("_band")
        banded = kept.where(inside).groupBy(*by, "_at", under).agg(F.sum("_c").alias("_c"))


def median(df: DataFrame, keys: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
