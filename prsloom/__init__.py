"""prsloom: polygenic analytics on Spark DataFrames."""

from prsloom.functions.columns import liability_factor, n_eff_case_control, slab_weight, standardize_beta
from prsloom.operators.finemap import single_signal
from prsloom.operators.harmonize import diagnose, harmonized, wanted
from prsloom.operators.ld import block_bounds, block_diagonal, compute_blocks, ld_scores, optimal_blocks, optimal_split, partition_h2, shrink_blocks
from prsloom.operators.ldsc import h2 as ldsc_h2
from prsloom.operators.ldsc import rg as ldsc_rg
from prsloom.operators.models import annot, auto, auto_rounds, bivariate, credible_sets, dentist, finemap, grid, impute, inf, infer, laplace, lassosum, low_rank_blocks
from prsloom.operators.qc import counts, flagged, imputed_n, passed, sd_consistent
from prsloom.operators.score import dosage_stats, ranked, scores
from prsloom.operators.simulate import run_one
from prsloom.plans.pipeline import FineMapResult, PRSResult, ScoreResult, preflight, run_finemap, run_prs, score_from_weights
from prsloom.sources.genotypes import Genotypes, load_genotypes
from prsloom.sources.text import detect_columns, read_annotations, read_sumstats

__version__ = "0.2.0"
__all__ = [name for name in dir() if not name.startswith("_")]
