"""LD score regression. Every fit of every jackknife replicate is one aggregate: the replicates' coefficients (at most
n_blocks + 1 rows) are broadcast to the variants, which send back five sums for each replicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jackknife_block(number: Column, m: Column, n_blocks: Column) -> Column:
    """Contiguous blocks whose first m mod n get one more, as array_split and ntile cut. number: 0-based."""
    size, more = F.floor(m / n_blocks), m % n_blocks
    big = more * (size + 1)
    return F.when(number < big, F.floor(number / (size + 1))).otherwise(more + F.floor((number - big) / F.greatest(size, F.lit(1)))).cast("long")


def _wls(rows: DataFrame, coefficients: DataFrame, x: str, y: str, w: Column, fixed: float | None) -> DataFrame:
    """(rep, slope, intercept) by replicate, which leaves its own block out; rep -1 leaves none."""
    each = rows.crossJoin(F.broadcast(coefficients)).filter("rep = -1 or rep != jk").withColumn("w", w)
    s = each.groupBy("rep").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col(x)).alias("sx"), F.sum(F.col("w") * F.col(y)).alias("sy"), F.sum(F.col("w") * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col("w") * F.col(x) * F.col(y)).alias("sxy"))
    if fixed is not None:
        return s.select("rep", ((F.col("sxy") - fixed * F.col("sx")) / F.col("sxx")).alias("slope"), F.lit(float(fixed)).alias("intercept"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    return s.withColumn("slope", slope).select("rep", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"))


def _weight(x: str) -> Column:
    mean = F.greatest(F.col("intercept") + F.col("slope") * F.col(x), F.lit(1.0))
    return 1.0 / (2.0 * mean * mean) / F.greatest(F.col("ell"), F.lit(1.0))


def _fit(rows: DataFrame, reps: DataFrame, x: str, y: str, rounds: int, fixed: float | None) -> DataFrame:
    now = reps.select("rep", F.lit(0.0).alias("slope"), F.lit(1.0).alias("intercept"))  # a mean of one
    for _ in range(rounds + 1):
        # the number of replicates bounds this: it is collected, so that plans do not nest
        found = _wls(rows, now, x, y, _weight(x), fixed).collect()
        now = rows.sparkSession.createDataFrame([tuple(r) for r in found], "rep long, slope double, intercept double")
    return now


def _prepared(rows: DataFrame, n_blocks: int, m_snps: float | None):
    one = rows.agg(F.count("*").alias("m")).collect()[0]
    m = one.m
    nb = min(n_blocks, m)
    rows = rows.withColumn("jk", jackknife_block(F.col("number"), F.lit(m), F.lit(nb)))
    reps = rows.sparkSession.createDataFrame([(k,) for k in range(-1, nb)], "rep long")
    return rows, reps, float(m_snps or m), nb


def _se(values: list[float]) -> float:
    n = len(values)
    mean = sum(values) / n
    return ((n - 1) / n * sum((v - mean) ** 2 for v in values)) ** 0.5


def h2(rows: DataFrame, n_blocks: int = 200, rounds: int = 2, intercept: float | None = None, m_snps: float | None = None) -> DataFrame:
    """rows (number, chisq, ell, n_eff) to one row: h2, h2_se, intercept, intercept_se, mean_chisq, ratio."""
    rows, reps, m, _ = _prepared(rows, n_blocks, m_snps)
    rows = rows.withColumn("x", F.col("n_eff") * F.col("ell") / m).persist()
    fits = {r.rep: r for r in _fit(rows, reps, "x", "chisq", rounds, intercept).collect()}
    mean = rows.agg(F.avg("chisq")).collect()[0][0]
    rows.unpersist()
    whole, parts = fits.pop(-1), list(fits.values())
    ratio = (whole.intercept - 1) / (mean - 1) if mean > 1 else None
    out = (whole.slope, _se([r.slope for r in parts]), whole.intercept, 0.0 if intercept is not None else _se([r.intercept for r in parts]), mean, ratio)
    return rows.sparkSession.createDataFrame([out], "h2 double, h2_se double, intercept double, intercept_se double, mean_chisq double, ratio double")


def rg(rows: DataFrame, n_blocks: int = 200, rounds: int = 2, intercept: float | None = None, m_snps: float | None = None) -> DataFrame:
    """rows (number, b1, b2, ell, n1, n2) to one row: rg, rg_se, gcov, gcov_intercept, h2_1, h2_2."""
    rows, reps, m, _ = _prepared(rows, n_blocks, m_snps)
    n12 = F.sqrt(F.col("n1") * F.col("n2"))
    rows = rows.withColumns({"y1": F.col("n1") * F.col("b1") * F.col("b1"), "y2": F.col("n2") * F.col("b2") * F.col("b2"), "yc": n12 * F.col("b1") * F.col("b2"), "x1": F.col("n1") * F.col("ell") / m, "x2": F.col("n2") * F.col("ell") / m, "xc": n12 * F.col("ell") / m}).persist()
    first, second = (_fit(rows, reps, f"x{k}", f"y{k}", rounds, None) for k in (1, 2))
    both = first.select("rep", F.col("slope").alias("s1"), F.col("intercept").alias("i1")).join(second.select("rep", F.col("slope").alias("s2"), F.col("intercept").alias("i2")), "rep")
    mean = lambda k: F.greatest(F.col(f"i{k}") + F.col(f"s{k}") * F.col(f"x{k}"), F.lit(1.0))
    w = 1.0 / (F.greatest(F.col("ell"), F.lit(1.0)) * mean(1) * mean(2))
    cross = {r.rep: r for r in _wls(rows, both, "xc", "yc", w, intercept).collect()}
    h = {r.rep: (r.s1, r.s2) for r in both.collect()}
    rows.unpersist()
    value = {k: cross[k].slope / max(h[k][0] * h[k][1], 1e-12) ** 0.5 for k in cross}
    whole = value.pop(-1)
    out = (whole, _se(list(value.values())), cross[-1].slope, cross[-1].intercept, *h[-1])
    return rows.sparkSession.createDataFrame([out], "rg double, rg_se double, gcov double, gcov_intercept double, h2_1 double, h2_2 double")
