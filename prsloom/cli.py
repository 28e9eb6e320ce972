"""python -m prsloom: fit and score, score from weights, check the inputs, or fine-map."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from prsloom.operators import models, score
from prsloom.plans import pipeline
from prsloom.sources import text


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser("prsloom", description=__doc__)
    # The names and defaults of the flags.
    a.add_argument("--sumstats", help="summary statistics (text, also gzip)")
    of = a.add_mutually_exclusive_group(required=True)
    of.add_argument("--plink", help="genotypes: prefix of .bed, .bim and .fam")
    of.add_argument("--bgen", help="genotypes: a .bgen file")
    a.add_argument("--sample", help=".sample file of a .bgen without ids")
    a.add_argument("--out", help="the scores' file, or the prefix of fine-mapping's files")
    a.add_argument("--method", choices=pipeline.METHODS, default="auto", help="auto turns to annot where annotations are given")
    a.add_argument("--annotations", help="a table of annotations by variant id")
    a.add_argument("--block-size", type=int, default=500)
    a.add_argument("--n-eff", type=number_or_name, help="effective sample size, or its column")
    a.add_argument("--n-cases", type=float, help="with --n-controls, in place of --n-eff")
    a.add_argument("--n-controls", type=float)
    a.add_argument("--h2", type=float, help="heritability (start value of auto)")
    a.add_argument("--p", type=float, help="share of causal variants (start value of auto; grid: 0.01)")
    a.add_argument("--seed", type=int, help="seed of the sampler")
    a.add_argument("--burn-in", type=int)
    a.add_argument("--num-iter", type=int)
    a.add_argument("--ld-prefix", help="genotypes of an LD panel")
    a.add_argument("--ld-ridge", type=float, default=0.0)
    a.add_argument("--ld-out", help="keep the LD blocks there")
    a.add_argument("--ld-cache", help="LD blocks kept before")
    a.add_argument("--ld-stream", action="store_true", help="taken as given: kept blocks are always read block by block")
    a.add_argument("--ncores", type=int, default=1, help="taken as given: the session has the cores")
    a.add_argument("--no-qc", action="store_true")
    a.add_argument("--no-sd-check", action="store_true")
    a.add_argument("--impute-n", action="store_true")
    a.add_argument("--dentist", action="store_true")
    a.add_argument("--ld-shrink", action="store_true")
    a.add_argument("--ld-sparse", action="store_true")
    a.add_argument("--ld-max-dist", type=int, help="with --ld-sparse: variants that are farther apart are uncorrelated")
    a.add_argument("--ld-lowrank", action="store_true")
    a.add_argument("--ld-lowrank-var", type=float, default=0.99)
    a.add_argument("--ld-lowrank-min-size", type=int, default=0)
    a.add_argument("--ldsc-init", action="store_true")
    a.add_argument("--auto-chains", type=int, default=1)
    a.add_argument("--alpha", type=float, default=-1.0)
    a.add_argument("--infer", action="store_true")
    a.add_argument("--dry-run", action="store_true", help="check the inputs and stop")
    a.add_argument("--save-weights", help="write the weights there")
    a.add_argument("--weights", help="score from these weights instead of fitting")
    a.add_argument("--scaling", choices=("target", "frozen"), default="target")
    a.add_argument("--score-chunk", type=int, default=1000, help="variants in a partition of the genotypes")
    a.add_argument("--prs-percentiles", action="store_true", help="add Z and PCT to the scores")
    a.add_argument("--finemap", action="store_true", help="credible sets instead of scores")
    a.add_argument("--regions", help="BED-like file: fine-map only there")
    a.add_argument("--finemap-coverage", type=float, default=0.95)
    a.add_argument("--finemap-max-signals", type=int, default=10)
    a.add_argument("--finemap-min-purity", type=float, default=0.5)
    a.add_argument("--finemap-only-significant", type=float, help="fine-map only blocks with a p value below this")
    return a


def number_or_name(value: str) -> float | str:
    try:
        return float(value)
    except ValueError:
        return value


def _told(**values) -> None:
    print(json.dumps(values, indent=1, default=str))


def _write_scores(scores: DataFrame, path: str, percentiles: bool) -> None:
    if percentiles:
        scores = score.ranked(scores.select("sidx", "score")).join(scores.select("sidx", "fid", "iid"), "sidx")
    text.write_scores(scores.orderBy("sidx"), path)


def main(argv: list[str] | None = None) -> int:
    a = parser()
    o = a.parse_args(argv)
    genotypes = o.plink or o.bgen
    if (o.n_cases is None) != (o.n_controls is None):
        a.error("--n-cases and --n-controls go together")
    n_eff = o.n_eff if o.n_cases is None else 4.0 / (1.0 / o.n_cases + 1.0 / o.n_controls)
    if not (o.weights or o.sumstats):
        a.error("--sumstats or --weights is needed")
    if not (o.dry_run or o.out):
        a.error("--out is needed")
    spark = SparkSession.builder.getOrCreate()
    if o.weights:
        found = pipeline.score_from_weights(spark, o.weights, genotypes, sample_path=o.sample, scaling=o.scaling)
        _write_scores(found.scores, o.out, o.prs_percentiles)
        _told(n_weights=found.n_weights, **found.log)
        return 0
    shared = {"n_eff": n_eff, "sample_path": o.sample, "qc_on": not o.no_qc}
    if o.dry_run:
        _told(**pipeline.preflight(spark, o.sumstats, genotypes, **shared))
        return 0
    shared |= {"block_size": o.block_size, "ld_prefix": o.ld_prefix, "ld_ridge": o.ld_ridge, "sd_check": not o.no_sd_check, "dentist": o.dentist}
    sampler = {k: v for k, v in (("seed", o.seed), ("burn_in", o.burn_in), ("num_iter", o.num_iter)) if v is not None}
    if o.finemap:
        found = pipeline.run_finemap(spark, o.sumstats, genotypes, regions=o.regions, out=o.out, only_significant=o.finemap_only_significant, coverage=o.finemap_coverage, max_signals=o.finemap_max_signals, min_abs_corr=o.finemap_min_purity, **shared, **sampler)
        _told(n_sets=found.sets.count(), **found.log)
        return 0
    if o.ld_lowrank and o.ld_sparse:
        a.error("--ld-lowrank and --ld-sparse exclude each other")
    method = "annot" if o.annotations and o.method == "auto" else o.method
    ld = {"ld_kind": "lowrank", "ld_params": {"variance": o.ld_lowrank_var, "least": o.ld_lowrank_min_size}} if o.ld_lowrank else {"ld_kind": "sparse", "ld_params": {"max_dist": o.ld_max_dist}} if o.ld_sparse else {}
    found = pipeline.run_prs(spark, o.sumstats, genotypes, method=method, h2=o.h2, p=o.p, ld_cache=o.ld_cache, ld_out=o.ld_out, ld_shrink=o.ld_shrink, impute_n=o.impute_n, annotations=o.annotations, auto_chains=o.auto_chains, ldsc_init=o.ldsc_init, alpha=o.alpha, infer=o.infer, **ld, **shared, **sampler)
    if o.save_weights:
        found.write_weights(o.save_weights)
    _write_scores(found.scores, o.out, o.prs_percentiles)
    told = {k: v for k, v in found.estimates.items() if isinstance(v, (int, float))}
    if "enrichment" in found.estimates:
        told["enrichment"] = dict(models.top_enrichments(found.estimates["enrichment"]))
    _told(**found.log, **told)
    return 0


if __name__ == "__main__":
    sys.exit(main())
