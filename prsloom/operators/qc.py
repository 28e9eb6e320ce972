"""Quality control of summary statistics: one pass of flags, one aggregate for all counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsloom.functions.columns import finite
from prsloom.tables import written

REASONS = ("nonfinite", "duplicate", "low_n", "low_maf", "low_info", "high_chisq")


def identity() -> Column:
    """The id, or where it is empty or a dot, the place and alleles."""
    known = F.coalesce(~F.col("id").isin("", "."), F.lit(False))
    return F.when(known, F.concat(F.lit("i:"), "id")).otherwise(F.concat_ws("|", F.lit("p:"), "chrom", F.col("pos").cast("string"), "ea", "oa"))


def flagged(ss: DataFrame, min_n_ratio: float = 0.7, min_maf: float = 0.01, min_info: float = 0.7, max_chisq: float | None = None, drop_duplicates: bool = True) -> DataFrame:
    """ss with `reason`: the first rule that drops the row, null if it stays.

    All copies of a repeated key go, counted over all rows; the sample size rule is against the largest of all rows.
    The key's count is an aggregate joined back, so that a key with very many rows is not gathered in one task. Keys are known by
    128 bits of hash, and rows stream past hash tables of the repeated ones, so that neither keys nor rows are sorted.
    """
    if drop_duplicates:
        rows = ss.withColumn("_key", identity()).withColumns({"_k1": F.xxhash64("_key"), "_k2": F.xxhash64(F.lit("key"), "_key")}).drop("_key")
        many = rows.groupBy(F.col("_k1").alias("_m1"), F.col("_k2").alias("_m2")).agg(F.count("*").alias("_copies")).filter("_copies > 1")
        rows = rows.join(many.hint("shuffle_hash"), (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2")), "left")
    else:
        rows = ss.withColumn("_copies", F.lit(None))
    rows = rows.crossJoin(F.broadcast(ss.agg(F.max(F.when(finite(F.col("n_eff")), F.col("n_eff"))).alias("_top"))))  # one row
    maf = F.least(F.col("eaf"), 1 - F.col("eaf"))
    reason = F.when(~(finite(F.col("beta")) & finite(F.col("se")) & (F.col("se") > 0)), "nonfinite")
    reason = reason.when(F.col("_copies") > 1, "duplicate")
    reason = reason.when(finite(F.col("n_eff")) & (F.col("n_eff") < min_n_ratio * F.col("_top")), "low_n")
    reason = reason.when(finite(F.col("eaf")) & (maf < min_maf), "low_maf")
    reason = reason.when(finite(F.col("info")) & (F.col("info") < min_info), "low_info")
    if max_chisq is not None:
        reason = reason.when(F.pow(F.when(F.col("se") != 0, F.col("beta") / F.col("se")), F.lit(2)) > max_chisq, "high_chisq")
    return rows.withColumn("reason", reason).drop("_k1", "_k2", "_m1", "_m2", "_copies", "_top")


def passed(ss: DataFrame, **rules) -> DataFrame:
    return flagged(ss, **rules).filter("reason is null").drop("reason")


def counts(flags: DataFrame) -> DataFrame:
    """n_in, n_<reason> and n_out in one row."""
    return flags.agg(F.count("*").alias("n_in"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS), F.count_if(F.col("reason").isNull()).alias("n_out"))


def sd_consistent(rows: DataFrame, low: float = 0.5, high: float = 2.0, least: float = 0.05) -> DataFrame:
    """rows (beta, se, n_eff, af_ref) with sd_ref, ratio and keep: the sd that the statistics imply, scaled by the
    median over all rows, against the sd of the genotypes."""
    sd_ref = F.sqrt(2 * F.col("af_ref") * (1 - F.col("af_ref")))
    scale = F.sqrt(F.col("n_eff") * F.col("se") * F.col("se") + F.col("beta") * F.col("beta"))
    rows = rows.withColumn("sd_ref", sd_ref).withColumn("_raw", F.when(scale > 0, 1 / scale))
    middle = rows.agg(F.expr("percentile(case when _raw > 0 then sd_ref / _raw end, 0.5)").alias("_k"))
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("ratio", F.when(F.col("sd_ref") > 0, F.col("_raw") * F.col("_k") / F.col("sd_ref")))
    keep = F.coalesce(finite(F.col("ratio")) & (F.col("sd_ref") >= least) & F.col("ratio").between(low, high), F.lit(False))
    return rows.withColumn("keep", keep).drop("_raw", "_k")


def imputed_n(rows: DataFrame, n_total: float, quantile: float = 0.99, use_info: bool = False) -> DataFrame:
    """rows (se, af_ref[, info]) with n_imputed: from se and frequency, anchored so that a high quantile is the total."""
    var = 2 * F.col("af_ref") * (1 - F.col("af_ref"))
    raw = F.when((F.col("se") > 0) & (var > 0), 1 / (F.col("se") * F.col("se") * var))
    rows = rows.withColumn("_raw", raw)
    top = rows.agg(F.expr(f"percentile(_raw, {quantile})").alias("_q"))
    n = F.col("_raw") * n_total / F.col("_q")
    if use_info:
        n = n * F.coalesce(F.col("info"), F.lit(1.0))
    out = rows.crossJoin(F.broadcast(top)).withColumn("n_imputed", F.least(F.coalesce(n, F.lit(float(n_total))), F.lit(float(n_total))))
    return out.drop("_raw", "_q")


def in_regions(rows: DataFrame, regions: DataFrame, limit: int = 100_000) -> DataFrame:
    """Rows inside any region (chrom, start, end), bounds included, chromosomes compared as written.

    Regions are counted first: up to `limit` they are broadcast; more are met through bins of the genome.
    """
    if regions.limit(limit + 1).count() <= limit:
        r = F.broadcast(regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")))
        return rows.join(r, (F.col("chrom") == F.col("_c")) & F.col("pos").between(F.col("_s"), F.col("_e")), "left_semi")
    size = 1_000_000
    r = regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.expr(f"sequence(start div {size}, end div {size})")).alias("_b"))
    return rows.withColumn("_bin", F.expr(f"pos div {size}")).join(r, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & F.col("pos").between(F.col("_s"), F.col("_e")), "left_semi").drop("_bin")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a gapless 0-based number in the order given, without one task that sorts all.

    Ranges are written, since Spark would sample other ones if it came back to them.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")
