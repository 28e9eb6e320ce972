"""Dosage statistics and polygenic scores.

Genotypes are one row for each variant, (vidx, dosage ARRAY), null a missing call: a shape that does not explode
with samples times variants. Statistics are aggregates over the array inside generated code; a score is a partial
vector for each partition, summed by sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsloom.tables import written

EPS = 1e-12
#: Samples in a score chunk: what is summed by key is a chunk, not a number.
CHUNK = 4096


def packed(calls: DataFrame, sample: str = "s", variant: str = "v", dosage: str = "g") -> DataFrame:
    """(vidx, dosage) from one row for each call, samples in order. Null calls stay in place."""
    pair = F.struct(F.col(sample).alias("s"), F.col(dosage).cast("double").alias("g"))
    return calls.groupBy(F.col(variant).alias("vidx")).agg(F.array_sort(F.collect_list(pair)).alias("x")).select("vidx", F.transform("x", lambda p: p["g"]).alias("dosage"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def dosage_stats(geno: DataFrame) -> DataFrame:
    """(vidx, n, n_called, af, mean, sd): sd after missing calls take the mean, so over all samples."""
    called = F.size(F.filter("dosage", lambda g: g.isNotNull()))
    first = geno.select("vidx", "dosage", F.size("dosage").cast("long").alias("n"), called.cast("long").alias("n_called"), _sum(F.col("dosage")).alias("total"))
    mean = F.when(F.col("n_called") > 0, F.col("total") / F.col("n_called")).otherwise(0.0)
    first = first.withColumn("mean", mean)
    squares = F.aggregate("dosage", F.lit(0.0), lambda s, g: s + F.coalesce((g - F.col("mean")) * (g - F.col("mean")), F.lit(0.0)))
    return first.select("vidx", "n", "n_called", (F.col("mean") / 2).alias("af"), "mean", F.sqrt(F.when(F.col("n") > 0, squares / F.col("n")).otherwise(0.0)).alias("sd"))


def standardized(geno: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(vidx, z): missing calls at the mean, columns that do not vary at 0."""
    rows = geno.join(stats if stats is not None else dosage_stats(geno), "vidx")
    z = F.transform("dosage", lambda g: F.when(F.col("sd") > EPS, (F.coalesce(g, F.col("mean")) - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return rows.select("vidx", z.alias("z"))


def _partial(standardize: bool, frozen: bool):
    def run(frames):
        total = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                g = np.asarray(row.dosage, np.float64)
                missing = np.isnan(g)
                if frozen:
                    mean, sd = row.mean, row.sd
                else:
                    mean = g[~missing].mean() if not missing.all() else 0.0
                    sd = np.sqrt((((np.where(missing, mean, g)) - mean) ** 2).mean())
                g = np.where(missing, mean, g)
                if standardize:
                    g = (g - mean) / sd if sd > EPS else np.zeros(len(g))
                part = row.weight * g
                total = part if total is None else total + part
        if total is not None:
            cuts = range(0, len(total), CHUNK)
            yield pd.DataFrame({"chunk": list(cuts), "part": [total[c : c + CHUNK] for c in cuts]})

    return run


def scores(geno: DataFrame, weights: DataFrame, standardize: bool = True, frozen: bool = False) -> DataFrame:
    """(sidx, score): sum over variants of weight times dosage. weights: vidx, weight and, if frozen, mean and sd."""
    if frozen and not {"mean", "sd"} <= set(weights.columns):
        raise ValueError("frozen scores need both mean and sd")
    columns = ["vidx", "weight", *(["mean", "sd"] if frozen else [])]
    rows = geno.join(weights.select(columns), "vidx").drop("vidx")
    parts = rows.mapInPandas(_partial(standardize or frozen, frozen), "chunk long, part array<double>")
    each = parts.select("chunk", F.posexplode("part").alias("k", "x"))
    return each.groupBy((F.col("chunk") + F.col("k")).alias("sidx")).agg(F.sum("x").alias("score"))


def ranked(scored: DataFrame, ref_mean: float | None = None, ref_sd: float | None = None, key: str = "sidx") -> DataFrame:
    """(key, score, z, pct): z against the scores' own mean and sd (over n) or a reference; ties share their average rank.

    Ranks come from a histogram of equal scores: the running count is a window over distinct scores in range partitions
    of the sort, with the partitions' totals added.
    """
    one = scored.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))
    counts = scored.groupBy("score").agg(F.count("*").alias("k"))
    # few distinct partitions: totals of each, then a window inside each. Written, since Spark would sample other ranges again
    parts = written(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "ranks")
    before = parts.groupBy("part").agg(F.sum("k").alias("t")).withColumn("earlier", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "earlier")
    below = F.coalesce(F.sum("k").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = parts.withColumn("below", below).join(F.broadcast(before), "part").select("score", (F.col("below") + F.col("earlier") + (F.col("k") - 1) / 2).alias("rank"))
    mean = F.lit(ref_mean) if ref_mean is not None else F.col("m")
    sd = F.lit(ref_sd) if ref_sd is not None else F.col("sd")
    out = scored.join(place, "score").crossJoin(F.broadcast(one))  # one row
    return out.select(key, "score", F.when(sd > 0, (F.col("score") - mean) / sd).otherwise(0.0).alias("z"), ((F.col("rank") + 0.5) / F.col("n")).alias("pct"))


def prediction_r2(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Squared correlation, 0 where either does not vary."""
    stats = pairs.agg(F.corr(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return stats.select(F.when((F.col("sa") < EPS) | (F.col("sb") < EPS), 0.0).otherwise(F.col("c") * F.col("c")).alias("r2"))
