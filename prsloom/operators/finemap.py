"""Single-signal fine-mapping as column expressions and windows over a locus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def single_signal(rows: DataFrame, prior_var: float = 0.04, coverage: float = 0.95, locus: str = "block_id") -> DataFrame:
    """rows (locus, vidx, beta, n): approximate Bayes factors, their shares as inclusion probabilities, the mixture's mean and sd,
    and whether the variant is in the smallest set that reaches the coverage. A locus is a block, so a window holds one block."""
    s2, z2 = 1.0 / F.col("n"), F.col("beta") * F.col("beta") * F.col("n")
    lbf = 0.5 * (F.ln(s2 / (s2 + prior_var)) + z2 * prior_var / (s2 + prior_var))
    whole = Window.partitionBy(locus)
    rows = rows.withColumn("lbf", lbf).withColumn("w", F.exp(F.col("lbf") - F.max("lbf").over(whole)))
    rows = rows.withColumn("pip", F.col("w") / F.sum("w").over(whole))
    var = 1.0 / (1.0 / prior_var + F.col("n"))
    mu = var * F.col("beta") * F.col("n")
    mean = F.col("pip") * mu
    sd = F.sqrt(F.greatest(F.col("pip") * (var + mu * mu) - mean * mean, F.lit(0.0)))
    down = Window.partitionBy(locus).orderBy(F.desc("pip"), "vidx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("pip").over(down), F.lit(0.0))
    return rows.select(locus, "vidx", "lbf", "pip", mean.alias("mean"), sd.alias("sd"), (before < coverage).alias("in_set"))
