"""Matching summary statistics to a genotype panel and aligning effect alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prsloom.functions.columns import complement, finite, norm_chrom, palindromic

ACTIONS = ("keep", "swap", "strand_keep", "strand_swap", "palindrome", "mismatch", "strand_nonfinite", "nonfinite")


def matched(ss: DataFrame, variants: DataFrame) -> DataFrame:
    """ss (row_no, id, chrom, pos, ea, oa, ...) with the variant each row hits: by id first, else by place.

    Two equi-joins on panels reduced to the first variant of each key; ids '' and '.' name nothing, and rows without an id are
    spread by a hash of their number. Statistics stream past hash tables of the panel's parts, so that they are never sorted.
    """
    v = variants.select("vidx", "id", norm_chrom(F.col("chrom")).alias("_vc"), "pos")
    by_id = v.filter("id is not null and id not in ('', '.')").groupBy(F.col("id").alias("_id")).agg(F.min("vidx").alias("_by_id")).withColumn("_ih", F.xxhash64("_id"))
    by_pos = v.groupBy(F.col("_vc").alias("_c"), F.col("pos").alias("_p")).agg(F.min("vidx").alias("_by_pos"))
    named = F.coalesce(~F.col("id").isin("", "."), F.lit(False))
    rows = ss.withColumns({"_nc": norm_chrom(F.col("chrom")), "_h": F.when(named, F.xxhash64("id")).otherwise(F.xxhash64("row_no"))})
    rows = rows.join(by_id.hint("shuffle_hash"), (F.col("_h") == F.col("_ih")) & (rows["id"] == F.col("_id")), "left")
    rows = rows.join(by_pos.hint("shuffle_hash"), (F.col("_nc") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    return rows.withColumn("vidx", F.coalesce("_by_id", "_by_pos")).drop("_id", "_ih", "_h", "_by_id", "_c", "_p", "_by_pos", "_nc")


def aligned(ss: DataFrame, variants: DataFrame, drop_ambiguous: bool = True) -> DataFrame:
    """All rows that hit a variant with their action, whether they fit (ok), and counted: rows after the first
    fitting one of their variant count nowhere."""
    a = variants.select(F.col("vidx").alias("_v"), F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))
    a = a.withColumns({"_b1": complement(F.col("a1")), "_b2": complement(F.col("a2"))})  # a variant's, not a row's: complements are their own inverse
    rows = matched(ss, variants).filter("vidx is not null").join(a.hint("shuffle_hash"), F.col("vidx") == F.col("_v")).drop("_v")
    # each step a column of its own: inlined into one expression they make a method too long to be compiled
    rows = rows.withColumns({"_ea": F.upper("ea"), "_oa": F.upper("oa"), "_good": finite(F.col("beta")) & finite(F.col("se"))})
    ea, oa, good = F.col("_ea"), F.col("_oa"), F.col("_good")
    stands = lambda x, y: (ea == F.col(x)) & (oa == F.col(y))
    fit = F.when(stands("a1", "a2"), "keep").when(stands("a2", "a1"), "swap").when(stands("_b1", "_b2"), "strand_keep").when(stands("_b2", "_b1"), "strand_swap")
    rows = rows.withColumn("_fit", fit)
    fit = F.col("_fit")
    action = F.when(palindromic(ea, oa) if drop_ambiguous else F.lit(False), "palindrome").when(fit.isNull(), "mismatch").when(good, fit)
    action = action.when(fit.isin("keep", "swap"), "nonfinite").otherwise("strand_nonfinite")
    rows = rows.withColumn("action", action).drop("_ea", "_oa", "_b1", "_b2", "_good", "_fit").withColumn("ok", F.col("action").isin("keep", "swap", "strand_keep", "strand_swap"))
    winner = F.min(F.when(F.col("ok"), F.col("row_no"))).over(Window.partitionBy("vidx"))
    return rows.withColumn("winner", winner).withColumn("counted", F.col("winner").isNull() | (F.col("row_no") <= F.col("winner")))


def harmonized(rows: DataFrame) -> DataFrame:
    """(vidx, row_no, beta, se, n_eff, flipped) of the rows that aligned() let through."""
    flip = F.col("action").isin("swap", "strand_swap")
    return rows.filter(F.col("ok") & (F.col("row_no") == F.col("winner"))).select("vidx", "row_no", F.when(flip, -F.col("beta")).otherwise(F.col("beta")).alias("beta"), "se", "n_eff", flip.alias("flipped"))


def log(rows: DataFrame) -> DataFrame:
    """One row of counts over the rows that count."""
    c = rows.filter("counted")
    has = lambda *names: F.count_if(F.col("action").isin(*names))
    return c.agg(
        has("keep", "swap", "strand_keep", "strand_swap").alias("n_matched"),
        has("swap", "strand_swap").alias("n_flipped"),
        has("strand_keep", "strand_swap", "strand_nonfinite").alias("n_strand_flipped"),
        has("palindrome").alias("n_palindrome"),
        has("mismatch", "nonfinite", "strand_nonfinite").alias("n_mismatch"),
    )


def diagnose(ss: DataFrame, variants: DataFrame) -> DataFrame:
    """Shared ids, shared places, and whether more than half of the shared ids stand at other places (another genome build)."""
    s = ss.filter("id is not null and id not in ('', '.')").groupBy("id").agg(F.min("pos").alias("p1"))
    v = variants.filter("id is not null and id not in ('', '.')").groupBy("id").agg(F.min("pos").alias("p2"))
    ids = s.join(v, "id").agg(F.count("*").alias("n_id_overlap"), F.count_if(F.col("p1") != F.col("p2")).alias("n_moved"))
    places = lambda x: x.select(norm_chrom(F.col("chrom")).alias("c"), "pos").distinct()
    both = places(ss).join(places(variants), ["c", "pos"], "left_semi").agg(F.count("*").alias("n_pos_overlap"))
    return ids.crossJoin(both).select("n_id_overlap", "n_pos_overlap", "n_moved", (F.col("n_moved") * 2 > F.col("n_id_overlap")).alias("build_mismatch"))


def explained(told: dict) -> str:
    """What the counts of diagnose() point to."""
    if told["build_mismatch"]:
        return "shared ids stand at other positions: another genome build?"
    if not told["n_id_overlap"] and not told["n_pos_overlap"]:
        return "neither ids nor positions are shared: other variants, or another build"
    return "variants are shared, but alleles do not fit: check the allele columns and the strand"


def on_panel(target: DataFrame, panel: DataFrame) -> DataFrame:
    """An external panel's variants by id (of repeated ids the first), with whether its dosages must be recoded to the
    target's first allele; alleles of the other strand count as the same."""
    p = panel.filter("id is not null and id not in ('', '.')").groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(F.col("vidx").alias("v"), F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))).alias("_p"))
    rows = target.join(p, F.col("id") == F.col("_id"))
    a1, a2, b1, b2 = F.upper("a1"), F.upper("a2"), F.col("_p.a1"), F.col("_p.a2")
    same, other = (a1 == b1) & (a2 == b2), (a1 == b2) & (a2 == b1)
    c1, c2 = complement(b1), complement(b2)
    strand, strand_other = (a1 == c1) & (a2 == c2), (a1 == c2) & (a2 == c1)
    recode = F.when(same, False).when(other, True).when(strand, False).when(strand_other, True)
    return rows.withColumn("recode", recode).filter("recode is not null").select("vidx", F.col("_p.v").alias("panel_vidx"), "recode")


def with_annotations(variants: DataFrame, annotations: DataFrame, names: list[str]) -> DataFrame:
    """Annotations by variant id, 0 where there are none; of repeated ids the last row (by row_no) counts."""
    last = annotations.groupBy(F.col("id").alias("_id")).agg(*(F.max_by(x, "row_no").alias(x) for x in names))
    rows = variants.join(last, F.col("id") == F.col("_id"), "left").drop("_id")
    return rows.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in names})


def wanted(variants: DataFrame, ss: DataFrame) -> DataFrame:
    """Variants that the statistics name; all of them if they name none."""
    ids = ss.filter("id is not null and id not in ('', '.')").select("id").distinct()
    found = variants.join(ids, "id", "left_semi")
    return found if found.limit(1).count() else variants
