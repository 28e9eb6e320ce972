"""From summary statistics and genotypes to scores, estimates and credible sets.

Each step's result is a table in the shared folder, which the next ones read: plans stay short, and nothing is computed twice.
Tables that no result needs are deleted at the end of a run. Of the genotypes only the variants that matched are read.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prsloom.functions import columns as C
from prsloom.operators import harmonize, ld, ldsc, models, qc, score
from prsloom.sources import text
from prsloom.sources.genotypes import Genotypes, load_genotypes
from prsloom.tables import scratch, written

METHODS = ("auto", "inf", "grid", "laplace", "lassosum2", "annot")


@dataclass
class PRSResult:
    scores: DataFrame  # sidx, fid, iid, score
    weights: DataFrame  # vidx, id, chrom, pos, a1, a2, weight, af_ref, sd_ref
    log: dict
    estimates: dict = field(default_factory=dict)

    def write_weights(self, path: str) -> str:
        text.write_weights(self.weights.orderBy("vidx"), path)
        return path


@dataclass
class ScoreResult:
    scores: DataFrame
    n_weights: int
    n_matched: int
    log: dict


@dataclass
class FineMapResult:
    variants: DataFrame  # vidx, id, chrom, pos, a1, a2, block_id, pip, mean, sd, z, beta, n, signal, coverage, purity_min, purity_mean
    sets: DataFrame  # block_id, signal, coverage, n_variants, lead_variant, lead_pip, purity_min, purity_mean, variants
    log: dict


def _statistics(spark, sumstats, n_eff, qc_on, qc_params, columns) -> tuple[DataFrame, dict]:
    """The rows that pass quality control, and its counts."""
    ss = sumstats if isinstance(sumstats, DataFrame) else text.read_sumstats(spark, sumstats, n_eff, **(columns or {}))
    if not qc_on:
        ss = written(ss, "statistics")
        return ss, {"n_in": ss.count()}
    flags = written(qc.flagged(ss, **(qc_params or {})), "flags")
    return flags.filter("reason is null").drop("reason"), qc.counts(flags).collect()[0].asDict()


def _genotypes(spark, path: str, sample_path, ss: DataFrame | None) -> tuple[Genotypes, DataFrame]:
    """Genotypes with their variants as a table, and the variants that the statistics name by id (all, if none)."""
    geno = load_genotypes(spark, path, sample_path)
    geno.variants, geno.samples = written(geno.variants, "variants"), written(geno.samples, "samples")
    return geno, geno.variants if ss is None else harmonize.wanted(geno.variants, ss)


def _matched(ss, variants: DataFrame) -> tuple[DataFrame, dict]:
    rows = written(harmonize.aligned(ss, variants), "aligned")
    log = {"n_sumstats": ss.count()} | harmonize.log(rows).collect()[0].asDict()
    if not log["n_matched"]:
        told = harmonize.diagnose(ss, variants).collect()[0].asDict()
        raise ValueError(f"no statistic matches the genotypes after harmonisation ({harmonize.explained(told)}): {log}; {told}")
    return written(harmonize.harmonized(rows), "matched"), log


def _panel(spark, geno: Genotypes, h: DataFrame, ld_prefix, ld_sample_path) -> tuple[Genotypes, DataFrame]:
    """Dosages that LD is computed from, by the target's vidx and first alleles, and the statistics of the variants it has. A
    missing call stays missing."""
    if ld_prefix is None:
        return geno.only(h), h
    panel = load_genotypes(spark, ld_prefix, ld_sample_path)
    both = written(harmonize.on_panel(geno.variants.join(h.select("vidx"), "vidx", "left_semi"), panel.variants), "panel")
    if not both.limit(1).count():
        raise ValueError("the LD panel shares no variants with the target")
    rows = panel.only(both.select(F.col("panel_vidx").alias("vidx"))).dosage.withColumnRenamed("vidx", "panel_vidx").join(both, "panel_vidx")
    dosage = rows.select("vidx", C.recoded(F.col("dosage").cast("array<double>"), F.col("recode")).alias("dosage"))
    h = written(h.join(both.select("vidx"), "vidx", "left_semi"), "shared")
    return Genotypes(geno.variants.join(both.select("vidx"), "vidx", "left_semi"), panel.samples, dosage), h


def _checked(h: DataFrame, stats: DataFrame, sd_check: bool, impute_n: bool, impute_params: dict | None, log: dict) -> DataFrame:
    """h with af_ref, without the rows whose sd does not fit the panel's."""
    rows = h.join(stats.select("vidx", F.col("af").alias("af_ref")), "vidx")
    if sd_check:
        flags = written(qc.sd_consistent(rows), "sd")
        log["n_sd_inconsistent"] = flags.filter("not keep").count()
        rows = flags.filter("keep").drop("sd_ref", "ratio", "keep")
    if impute_n:
        params = dict(impute_params or {})
        total = params.pop("n_total", None) or rows.agg(F.max("n_eff")).collect()[0][0]
        rows = qc.imputed_n(rows, total, **params).withColumn("n_eff", F.col("n_imputed")).drop("n_imputed")
    rows = written(rows, "checked")
    if not rows.limit(1).count():
        raise ValueError(f"no variant is left after quality control: {log}")
    return rows


@dataclass
class _Fit:
    """What models work on: blocks, and effects by the blocks' vidx (with file_vidx and sign)."""

    blocks: DataFrame
    effects: DataFrame
    members: DataFrame  # vidx, file_vidx, block_id


def _effects(rows: DataFrame, members: DataFrame) -> DataFrame:
    """vidx, file_vidx, sign, beta, n: standardized effects on the blocks' alleles."""
    std = C.standardize_beta(F.col("beta"), F.col("se"), F.col("n_eff")) * F.col("sign")
    joined = members.join(rows.withColumnRenamed("vidx", "file_vidx"), "file_vidx")
    return written(joined.select("vidx", "file_vidx", "sign", std.alias("beta"), F.col("n_eff").alias("n"), (F.col("sign") * F.col("beta") / F.col("se")).alias("z")), "effects")


def _built(rows: DataFrame, panel: Genotypes, block_size: int, ridge: float, ld_kw: dict) -> _Fit:
    """Blocks over the variants that stay, numbered anew without gaps in the file's order."""
    kept = panel.variants.join(rows.select("vidx"), "vidx", "left_semi").withColumnRenamed("vidx", "file_vidx")
    numbered = written(qc.numbered(kept, ["file_vidx"], "vidx"), "numbered")
    bounds = written(ld.block_bounds(numbered, block_size), "bounds")
    members = written(numbered.select("vidx", "file_vidx", F.lit(1.0).alias("sign")).join(bounds.select("vidx", "block_id"), "vidx"), "members")
    dosage = panel.dosage.withColumnRenamed("vidx", "file_vidx").join(members.select("file_vidx", "vidx"), "file_vidx").drop("file_vidx")
    return _Fit(written(ld.compute_blocks(dosage, bounds, ridge, **ld_kw), "blocks"), _effects(rows, members), members)


def _from_cache(spark, path: str, rows: DataFrame, variants: DataFrame) -> _Fit:
    """Blocks of an earlier run, met by variant id: the cache says which variants there are and in what order."""
    blocks = ld.load(spark, path)
    own = variants.join(rows.select("vidx"), "vidx", "left_semi")
    spans = blocks.select("block_id", F.explode(F.expr("sequence(start, start + k - 1)")).alias("vidx"))
    members = written(ld.align(blocks, own).join(spans, "vidx"), "members")
    return _Fit(blocks.drop("key", "a1", "a2"), _effects(rows, members), members)


def _without_outliers(fit: _Fit, rows: DataFrame, params: dict | None, log: dict) -> DataFrame:
    """rows without those that DENTIST drops."""
    flags = written(models.dentist(fit.blocks, fit.effects, **(params or {})), "dentist")
    log["n_dentist"] = flags.filter("not keep").count()
    bad = fit.effects.join(flags.filter("not keep").select("vidx"), "vidx", "left_semi").select(F.col("file_vidx").alias("vidx"))
    kept = written(rows.join(bad, "vidx", "left_anti"), "kept")
    if not kept.limit(1).count():
        raise ValueError("all variants failed the DENTIST check")
    return kept


def _with_slab(fit: _Fit, target: DataFrame, alpha: float) -> DataFrame:
    """Effects with relative slab variances by allele frequency, of mean 1 in each block."""
    af = target.select(F.col("vidx").alias("file_vidx"), C.slab_weight(F.col("af"), alpha).alias("_w"))
    rows = fit.effects.join(af, "file_vidx").join(fit.members.select("vidx", "block_id"), "vidx")
    return rows.withColumn("slab", F.coalesce(F.col("_w") / F.avg("_w").over(Window.partitionBy("block_id")), F.lit(1.0))).drop("_w", "block_id")


def run_prs(spark: SparkSession, sumstats, genotypes: str, *, method: str = "auto", block_size: int = 500, n_eff=None, h2: float | None = None, p: float | None = None, ld_prefix=None, ld_ridge: float = 0.0, ld_cache: str | None = None, ld_out: str | None = None, sample_path=None, ld_sample_path=None, subset_to_sumstats: bool = True, qc_on: bool = True, qc_params=None, sd_check: bool = True, impute_n: bool = False, impute_n_params=None, dentist: bool = False, dentist_params=None, ld_shrink: bool = False, ld_shrink_params=None, ld_kind: str = "dense", ld_params=None, annotations: str | None = None, annot_params=None, auto_chains: int = 1, ldsc_init: bool = False, alpha: float = -1.0, infer: bool = False, infer_params=None, sumstats_cols=None, **model) -> PRSResult:
    """Fit weights and score. See the CLI for what the options mean; model options go to the method."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if ld_kind != "dense" and dentist:
        raise ValueError("dentist needs dense LD blocks")
    if ld_kind != "dense" and method == "lassosum2":
        raise ValueError("lassosum2 needs dense LD blocks")
    if alpha != -1.0 and (method not in ("auto", "grid") or (method == "auto" and auto_chains > 1)):
        raise ValueError("alpha, the prior by allele frequency, goes with grid and with auto of one chain")
    if ld_cache and (dentist or ld_shrink or impute_n):
        warnings.warn("an LD cache is used as it is: no N imputation, shrinking or DENTIST", stacklevel=2)
    with scratch(spark) as stay:
        ss, log = _statistics(spark, sumstats, n_eff, qc_on, qc_params, sumstats_cols)
        if not log.get("n_out", log["n_in"]):
            raise ValueError(f"quality control left nothing of {log['n_in']} rows: {log}")
        geno, named = _genotypes(spark, genotypes, sample_path, ss if subset_to_sumstats else None)
        h, more = _matched(ss, named)
        log |= more
        if ld_cache:
            panel, rows, stats = None, h, None
            fit = _from_cache(spark, ld_cache, rows, geno.variants)
        else:
            panel, h = _panel(spark, geno, h, ld_prefix, ld_sample_path)
            stats = written(score.dosage_stats(panel.dosage), "stats")
            rows = _checked(h, stats, sd_check, impute_n, impute_n_params, log)
            ld_kw = {"kind": ld_kind, **(ld_params or {})}
            fit = _built(rows, panel, block_size, ld_ridge, ld_kw)
            if dentist:
                rows = _without_outliers(fit, rows, dentist_params, log)
                if log["n_dentist"]:
                    fit = _built(rows, panel, block_size, ld_ridge, ld_kw)
            if ld_shrink:
                fit.blocks = written(ld.shrink_blocks(fit.blocks, panel.samples.count(), **(ld_shrink_params or {})), "shrunk")
            if ld_out:
                ld.save(fit.blocks, panel.variants.withColumnRenamed("vidx", "file_vidx").join(fit.members.select("vidx", "file_vidx"), "file_vidx"), ld_out)
        effects, blocks = fit.effects, fit.blocks
        log["n_final"] = effects.count()
        target = geno.only(effects.select(F.col("file_vidx").alias("vidx")))
        # without a panel of its own, LD came from the target: its statistics are there already
        own = stats if stats is not None and ld_prefix is None else written(score.dosage_stats(target.dosage), "target")
        estimates: dict = {}
        if (ldsc_init or (h2 is None and method in ("inf", "grid", "laplace"))) and not blocks.filter("kind != 'dense'").limit(1).count():
            scored = ld.ld_scores(blocks).join(effects, "vidx").select(F.col("vidx").alias("number"), (F.col("n") * F.col("beta") * F.col("beta")).alias("chisq"), F.col("ld_score").alias("ell"), F.col("n").alias("n_eff"))
            told = ldsc.h2(written(scored, "scored")).collect()[0].h2
            estimates["ldsc_h2"] = min(max(told, 1e-3), 1.0)
            h2 = estimates["ldsc_h2"] if h2 is None else h2
        if method in ("inf", "grid", "laplace") and h2 is None:
            h2 = 0.1
        start = ({"h2": h2} if h2 is not None else {}) | ({"p": p} if p is not None else {})
        if alpha != -1.0:
            effects = _with_slab(fit, own, alpha)
            log["alpha"] = alpha
        if method == "inf":
            fitted = models.inf(blocks, effects, h2)
        elif method == "grid":
            fitted = models.grid(blocks, effects, h2, 0.01 if p is None else p, **model)
        elif method == "laplace":
            fitted = models.laplace(blocks, effects, h2, **model)
        elif method == "lassosum2":
            fitted, grid = models.lassosum(blocks, effects, **model)
            estimates["grid"] = grid.collect()  # a row for each penalty and shrinkage
        elif method == "annot":
            if annotations is None:
                raise ValueError("method annot needs annotations")
            a, names = text.read_annotations(spark, annotations)
            ids = geno.variants.select(F.col("vidx").alias("file_vidx"), "id")
            e = harmonize.with_annotations(effects.join(ids, "file_vidx"), a, names)
            fitted, more = models.annot(blocks, e, names, **(annot_params or {}), **model)
            estimates |= more
        elif auto_chains > 1:
            fitted, told = models.infer(blocks, effects, n_chains=auto_chains, **({"h2": h2} if h2 is not None else {}), **(infer_params or {}), **model)
            if infer:
                estimates |= told.collect()[0].asDict()
        else:
            fitted, told = models.auto(blocks, effects, **start, **({"shared": False} if alpha != -1.0 else {}), **model)
            estimates |= told
        if infer and not (method == "auto" and auto_chains > 1):
            estimates |= models.infer(blocks, fit.effects, **(infer_params or {}))[1].collect()[0].asDict()
        w = written(fitted.join(effects.select("vidx", "file_vidx", "sign"), "vidx").select(F.col("file_vidx").alias("vidx"), (F.col("beta") * F.col("sign")).alias("weight")), "fitted")
        weights = written(geno.variants.join(w, "vidx").join(own.select("vidx", F.col("af").alias("af_ref"), F.col("sd").alias("sd_ref")), "vidx").select("vidx", "id", "chrom", "pos", "a1", "a2", "weight", "af_ref", "sd_ref"), "weights")
        scores = written(geno.samples.join(score.scores(target.dosage, w), "sidx").select("sidx", "fid", "iid", "score"), "scores")
        stay += [weights, scores]
    return PRSResult(scores, weights, log, estimates)


def run_finemap(spark: SparkSession, sumstats, genotypes: str, *, regions=None, out: str | None = None, n_eff=None, block_size: int = 500, ld_prefix=None, ld_ridge: float = 0.0, sample_path=None, ld_sample_path=None, subset_to_sumstats: bool = True, qc_on: bool = True, qc_params=None, sd_check: bool = True, dentist: bool = False, dentist_params=None, only_significant: float | None = None, coverage: float = 0.95, max_signals: int = 10, min_abs_corr: float = 0.5, sumstats_cols=None, **model) -> FineMapResult:
    """Inclusion probabilities and credible sets; with out also as out.pip.tsv and out.cs.tsv.

    regions: a file, a DataFrame (chrom, start, end) or a list of (chrom, start, end).
    """
    with scratch(spark) as stay:
        ss, log = _statistics(spark, sumstats, n_eff, qc_on, qc_params, sumstats_cols)
        geno, named = _genotypes(spark, genotypes, sample_path, ss if subset_to_sumstats else None)
        h, more = _matched(ss, named)
        log |= more
        if regions is not None:
            if isinstance(regions, list):
                regions = spark.createDataFrame([(str(r[0]), int(r[1]), int(r[2])) for r in regions], "chrom string, start long, end long")
            r = text.read_regions(spark, regions) if isinstance(regions, str) else regions
            inside = written(qc.in_regions(geno.variants.join(h.select("vidx"), "vidx", "left_semi"), r).select("vidx"), "inside")
            if not inside.limit(1).count():
                raise ValueError("no matched variant lies in the regions")
        panel, h = _panel(spark, geno, h, ld_prefix, ld_sample_path)
        # the scale of the sd check is a median over all variants, so regions come after it
        rows = _checked(h, written(score.dosage_stats(panel.dosage), "stats"), sd_check, False, None, log)
        if regions is not None:
            rows = written(rows.join(inside, "vidx", "left_semi"), "regions")
        fit = _built(rows, panel, block_size, ld_ridge, {})
        if dentist:
            rows = _without_outliers(fit, rows, dentist_params, log)
            if log["n_dentist"]:
                fit = _built(rows, panel, block_size, ld_ridge, {})
        found = models.finemap(fit.blocks, fit.effects, only_significant, coverage, min_abs_corr, max_signals, **model)
        named = fit.effects.join(geno.variants.withColumnRenamed("vidx", "file_vidx"), "file_vidx")
        variants = found.join(named, "vidx").select("vidx", "id", "chrom", "pos", "a1", "a2", "block_id", "pip", "mean", "sd", (F.col("beta") * F.sqrt("n")).alias("z"), "beta", "n", "signal", "coverage", "purity_min", "purity_mean")
        variants = written(variants, "pip")
        log |= {"n_blocks": fit.blocks.count(), "n_blocks_finemapped": variants.select("block_id").distinct().count()}
        sets = written(models.credible_sets(variants), "sets")
        stay += [variants, sets]
    if out is not None:
        text.write_finemap(variants, sets, out)
    return FineMapResult(variants, sets, log)


def preflight(spark: SparkSession, sumstats: str, genotypes: str, *, n_eff=None, sample_path=None, qc_on: bool = True, qc_params=None, subset_to_sumstats: bool = True, sumstats_cols=None) -> dict:
    """A report without LD or a model: columns, header, missing, and where nothing is missing n_sumstats, n_after_qc, qc,
    harmonize, diagnosis; warnings always. Bad inputs are reported, not raised."""
    header = text.header_of(spark, sumstats)
    columns = {k: header[i] for k, i in text.columns_of(header, sumstats_cols).items()}
    out = {"columns": columns, "header": header, "missing": text.missing_columns(columns, n_eff), "warnings": []}
    if out["missing"]:
        out["warnings"].append("needed columns were not found: name them in sumstats_cols")
        return out
    with scratch(spark):
        ss, log = _statistics(spark, sumstats, n_eff, qc_on, qc_params, sumstats_cols)
        out |= {"n_sumstats": log["n_in"], "n_after_qc": log.get("n_out", log["n_in"]), "qc": log}
        if not out["n_after_qc"]:
            out["warnings"].append("quality control drops all rows")
            return out
        geno, named = _genotypes(spark, genotypes, sample_path, None)
        rows = written(harmonize.aligned(ss, named), "aligned")
        told = harmonize.diagnose(ss, named).collect()[0].asDict()
        h = {"n_sumstats": out["n_after_qc"]} | harmonize.log(rows).collect()[0].asDict()
        h["n_unmatched"] = h["n_sumstats"] - rows.count()
        out |= {"n_genotype_variants": geno.m, "harmonize": h, "diagnosis": told}
    if not told["n_id_overlap"]:
        out["warnings"].append("no ids are shared: matching goes by position")
    if told["build_mismatch"]:
        out["warnings"].append("most shared ids stand at other positions: another genome build?")
    if not h["n_matched"]:
        out["warnings"].append("nothing matches after harmonisation: check build and alleles")
    elif h["n_mismatch"] * 2 > h["n_sumstats"]:
        out["warnings"].append("more than half of the alleles do not fit")
    return out


def score_from_weights(spark: SparkSession, weights, genotypes: str, *, sample_path=None, scaling: str = "target") -> ScoreResult:
    """Score new samples. scaling: target (their own means and sds), frozen (the file's), or none."""
    if scaling not in ("target", "frozen", "none"):
        raise ValueError("scaling is target, frozen or none")
    w = weights if isinstance(weights, DataFrame) else text.read_weights(spark, weights)
    if scaling == "frozen" and not {"af_ref", "sd_ref"} <= set(w.columns):
        raise ValueError("frozen scaling needs AF_REF and SD_REF, which the weights do not have")
    with scratch(spark) as stay:
        geno, _ = _genotypes(spark, genotypes, sample_path, None)
        ss = w.select("row_no", "id", "chrom", "pos", F.col("a1").alias("ea"), F.col("a2").alias("oa"), F.col("weight").alias("beta"), F.lit(1.0).alias("se"), F.lit(1.0).alias("n_eff"))
        h, log = _matched(ss, geno.variants)
        own = h.select("vidx", F.col("beta").alias("weight"), "flipped", "row_no")
        if scaling == "frozen":
            own = own.join(w.select("row_no", "af_ref", "sd_ref"), "row_no").select("vidx", "weight", C.frozen_mean(F.col("af_ref"), F.col("flipped")).alias("mean"), F.col("sd_ref").alias("sd"))
        found = score.scores(geno.only(h).dosage, own, standardize=scaling == "target", frozen=scaling == "frozen")
        scores = written(geno.samples.join(found, "sidx").select("sidx", "fid", "iid", "score"), "scores")
        stay.append(scores)
    return ScoreResult(scores, log["n_sumstats"], log["n_matched"], log)
