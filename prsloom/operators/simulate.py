"""Simulated panels and cohorts, for benchmarks and tests.

`panel` makes LD blocks and marginal effects of any number of variants where they will be used, a block a row; `cohort` makes whole
genotypes with NumPy, and `run_one` goes from them to the accuracy of a method.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsloom.functions.kernels import Dense
from prsloom.operators import ld, models, score
from prsloom.operators.ld import BLOCK, _encode
from prsloom.tables import scratch, written


def ar1(k: int, rho: float) -> np.ndarray:
    """Correlations that fall geometrically with distance."""
    return rho ** np.abs(np.subtract.outer(np.arange(k), np.arange(k)))


def panel(spark: SparkSession, m: int, block_size: int = 500, rho: float = 0.5, h2: float = 0.5, p: float = 0.01, n: float = 50_000.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(blocks, effects with the true ones): AR(1) blocks, a share p of causal variants, marginal effects with the noise of a study
    of n samples. A block's numbers hang on the seed and the block alone."""

    def run(frames):
        for frame in frames:
            for b in frame["id"]:
                start = int(b) * block_size
                k = min(block_size, m - start)
                rng = np.random.default_rng([seed, int(b)])
                r = ar1(k, rho)
                true = np.where(rng.random(k) < p, rng.standard_normal(k), 0.0) * np.sqrt(h2 / (m * p))
                hat = r @ true + np.linalg.cholesky(r) @ rng.standard_normal(k) / np.sqrt(n)
                yield pd.DataFrame([_encode(start, start, Dense(r)) | {"true": true, "hat": hat}])

    made = written(spark.range(-(-m // block_size)).mapInPandas(run, f"{BLOCK}, true array<double>, hat array<double>"), "panel", codec="none")
    rows = made.select("start", F.posexplode(F.arrays_zip("hat", "true")).alias("i", "x"))
    return made.drop("true", "hat"), rows.select((F.col("start") + F.col("i")).alias("vidx"), F.col("x.hat").alias("beta"), F.lit(float(n)).alias("n"), F.col("x.true").alias("true"))


def genotypes(n: int, block_sizes, maf, rho: float, rng: np.random.Generator) -> np.ndarray:
    """Dosages (samples by variants): two latent Gaussian haplotypes, AR(1) within a block, cut at the allele frequency."""
    from statistics import NormalDist

    limits = np.array([NormalDist().inv_cdf(1 - float(f)) for f in maf])
    out = np.zeros((n, len(limits)), np.int8)
    for _ in range(2):
        at = 0
        for k in block_sizes:
            z = rng.standard_normal((n, k))
            for j in range(1, k):
                z[:, j] = rho * z[:, j - 1] + np.sqrt(1 - rho * rho) * z[:, j]
            out[:, at : at + k] += z > limits[at : at + k]
            at += k
    return out


def mosaic_genotypes(n: int, m: int, rng: np.random.Generator, founders: int = 40, switch: float = 0.02, min_maf: float = 0.01) -> np.ndarray:
    """Dosages with LD as in real panels, plateaus and long-range tails: haplotypes are mosaics of a few founders' whose own mutations
    came about on a random genealogy. It stands in for a coalescent simulation, which would need a library."""
    sites: list[np.ndarray] = []
    while len(sites) < m:
        # a random genealogy: founders are merged in pairs, and each merged branch may carry the mutation
        groups = [np.array([k]) for k in range(founders)]
        branches = []
        while len(groups) > 1:
            a, b = (groups.pop(int(rng.integers(len(groups)))) for _ in range(2))
            groups.append(np.concatenate([a, b]))
            branches += [a, b]
        for _ in range(int(rng.integers(5, 40))):  # sites that share the genealogy
            own = np.zeros(founders, bool)
            own[branches[int(rng.integers(len(branches)))]] = True
            sites.append(own)
    founder = np.array(sites[:m]).T
    out = np.zeros((n, m), np.int8)
    for _ in range(2):
        moved = rng.random((n, m)) < switch
        moved[:, 0] = True
        segment = np.cumsum(moved, axis=1) - 1
        source = rng.integers(0, founders, (n, int(segment.max()) + 1))
        out += founder[np.take_along_axis(source, segment, 1), np.arange(m)[None, :]]
    share = out.mean(0) / 2
    rare = np.minimum(share, 1 - share) < min_maf
    out[:, rare] = rng.binomial(2, 0.2, (n, int(rare.sum())))
    return out


def prediction_r2(predicted, target) -> float:
    """Squared correlation, 0 where either does not vary."""
    a, b = np.asarray(predicted, float), np.asarray(target, float)
    return 0.0 if a.std() < 1e-12 or b.std() < 1e-12 else float(np.corrcoef(a, b)[0, 1] ** 2)


def run_one(spark: SparkSession, n_train: int, h2: float, p: float, *, m: int = 1000, block_size: int = 100, n_test: int = 2000, rho: float = 0.5, method: str = "auto", seed: int = 1, **options) -> dict:
    """One replicate: simulate, fit on the training samples' marginal effects, score the others. r2 is against the genetic value."""
    rng = np.random.default_rng(seed)
    sizes = [min(block_size, m - a) for a in range(0, m, block_size)]
    g = genotypes(n_train + n_test, sizes, rng.uniform(0.05, 0.5, m), rho, rng)
    beta = np.where(rng.random(m) < p, rng.standard_normal(m), 0.0)
    train, test = g[:n_train], g[n_train:]
    mean, sd = train.mean(0), np.maximum(train.std(0), 1e-9)
    value = ((g - mean) / sd) @ beta
    value *= np.sqrt(h2) / max(value[:n_train].std(), 1e-12)
    y = value[:n_train] + rng.standard_normal(n_train) * np.sqrt(1 - h2)
    hat = ((train - mean) / sd).T @ ((y - y.mean()) / y.std()) / n_train
    table = lambda rows: spark.createDataFrame([(v, [float(x) for x in rows[:, v]]) for v in range(m)], "vidx long, dosage array<double>")
    with scratch(spark):
        bounds = spark.createDataFrame([(v, v // block_size * block_size, v % block_size) for v in range(m)], "vidx long, block_id long, place long")
        blocks = written(ld.compute_blocks(table(train), bounds), "blocks")
        effects = spark.createDataFrame([(v, float(hat[v]), float(n_train)) for v in range(m)], "vidx long, beta double, n double")
        began = time.time()
        fit = {"auto": lambda: models.auto(blocks, effects, **options)[0], "inf": lambda: models.inf(blocks, effects, h2), "grid": lambda: models.grid(blocks, effects, h2, p, **options), "laplace": lambda: models.laplace(blocks, effects, h2, **options), "lassosum2": lambda: models.lassosum(blocks, effects, **options)[0]}[method]
        weights = written(fit().select("vidx", F.col("beta").alias("weight")), "weights")
        seconds = time.time() - began
        found = [r.score for r in score.scores(table(test), weights).orderBy("sidx").collect()]
    return {"method": method, "r2": prediction_r2(found, value[n_train:]), "seconds": seconds}
