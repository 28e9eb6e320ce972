"""Models over a table of LD blocks and a table of effects (vidx, beta, n).

Models without shared hyper-parameters sweep over the blocks of an Arrow batch side by side. Samplers that pool h2, p and the
like over all blocks after each sweep run in one barrier stage (`pooled`), every block in the task that reads it.
Streams of random numbers hang on the seed and the block, so that results do not depend on partitioning.
"""

from __future__ import annotations

import math
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsloom.functions import kernels
from prsloom.operators.ld import BLOCK, _encode, decode, with_effects
from prsloom.operators.pooled import run_pooled
from prsloom.tables import drop, once, written

EFFECTS = "vidx long, beta double"
#: Bytes of LD that blocks taken side by side may have (a larger one is taken alone).
SIDE_BYTES = 256 << 20


def _of_tables(model):
    """A model reads its blocks and effects several times: what is not a table yet is computed and written once."""

    @wraps(model)
    def run(blocks: DataFrame, effects: DataFrame, *args, **kw):
        return model(once(blocks, "blocks"), once(effects, "effects"), *args, **kw)

    return run


def _side_by_side(frames):
    """Lists of rows that are taken together."""
    for frame in frames:
        held, size = [], 0
        for row in frame.itertuples(index=False):
            held.append(row)
            size += len(row.data) * 2
            if size >= SIDE_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def _by_blocks(rows: DataFrame, schema: str, f) -> DataFrame:
    """f: of a list of rows, a frame."""

    def run(frames):
        for held in _side_by_side(frames):
            yield f(held)

    return rows.mapInPandas(run, schema)


def _by_block(rows: DataFrame, schema: str, f) -> DataFrame:
    return _by_blocks(rows, schema, lambda held: pd.concat([f(x) for x in held], ignore_index=True))


def _vidx(row):
    return row.start + np.arange(row.k)


def _all_vidx(held) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_vidx(x) for x in held)])


def _joined(held, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.asarray(getattr(x, f"e_{name}"), np.float64) for x in held)])


def _total(blocks: DataFrame) -> tuple[int, int]:
    """Variants and blocks."""
    one = blocks.agg(F.sum("k").alias("m"), F.count("*").alias("n")).collect()[0]
    return int(one.m or 0), int(one.n)


def _dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of blocks in as many partitions as there are slots, or more where those would be large: fitting a block takes far longer
    than moving it, so partitions that Spark joins because they are small would leave slots idle."""
    one = blocks.agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("size")).collect()[0]
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(one.n, max(slots, (one.size or 0) // SIDE_BYTES + 1))))


def _seeds(held, seed: int) -> list[int]:
    return [int((seed + x.block_id) % (1 << 32)) for x in held]


@_of_tables
def inf(blocks: DataFrame, effects: DataFrame, h2: float, m: int | None = None) -> DataFrame:
    """Infinitesimal model; h2 is shared out by block size."""
    m = m or _total(blocks)[0]
    return _by_block(_dealt(with_effects(blocks, effects), blocks), EFFECTS, lambda x: pd.DataFrame({"vidx": _vidx(x), "beta": kernels.infinitesimal(decode(x), x.e_beta, x.e_n, h2 * x.k / m)}))


def _optional(effects: DataFrame) -> tuple[str, ...]:
    """Columns of effects that change the prior: prior (relative inclusion probability) and slab (relative variance)."""
    return tuple(c for c in ("prior", "slab") if c in effects.columns)


@_of_tables
def grid(blocks: DataFrame, effects: DataFrame, h2: float, p: float, seed: int = 1, m: int | None = None, **kw) -> DataFrame:
    """Fixed h2 and p. effects may have columns prior and slab."""
    m = m or _total(blocks)[0]
    extra = _optional(effects)

    def run(held):
        found = kernels.grids([decode(x) for x in held], _joined(held, "beta"), _joined(held, "n"), [h2 * x.k / m for x in held], p, seeds=_seeds(held, seed), **kw, **{c: _joined(held, c) for c in extra})
        return pd.DataFrame({"vidx": _all_vidx(held), "beta": found})

    return _by_blocks(_dealt(with_effects(blocks, effects, extra), blocks), EFFECTS, run)


@_of_tables
def laplace(blocks: DataFrame, effects: DataFrame, h2: float, seed: int = 1, m: int | None = None, **kw) -> DataFrame:
    m = m or _total(blocks)[0]

    def run(held):
        found = kernels.laplaces([decode(x) for x in held], _joined(held, "beta"), _joined(held, "n"), [h2 * x.k / m for x in held], seeds=_seeds(held, seed), **kw)
        return pd.DataFrame({"vidx": _all_vidx(held), "beta": found})

    return _by_blocks(_dealt(with_effects(blocks, effects), blocks), EFFECTS, run)


@_of_tables
def lassosum(blocks: DataFrame, effects: DataFrame, s_seq=(0.2, 0.5, 0.9), n_lambda: int = 20, ratio: float = 0.01, max_iter: int = 100, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(effects of the best model, grid of s, lambda, score, n_nonzero). Every batch of blocks goes down the penalties of each s
    and reports what the score needs; the sums over blocks choose. Where no model scores at most 1, no effect is kept."""
    top = effects.agg(F.max(F.abs("beta"))).collect()[0][0] or 0.0
    lambdas = np.exp(np.linspace(math.log(top), math.log(top * ratio), n_lambda)) if top > 0 else np.zeros(1)

    def path(held):
        decoded, out = [decode(x) for x in held], []
        for s in s_seq:
            for x, steps in zip(held, kernels.lasso_paths(decoded, _joined(held, "beta"), s, lambdas, max_iter, tol), strict=True):
                out += [{"s": s, "step": k, "vidx": _vidx(x), "beta": b, "br": br, "brb": brb} for k, (b, br, brb) in enumerate(steps)]
        return pd.DataFrame(out)

    found = written(_by_blocks(_dealt(with_effects(blocks, effects), blocks), "s double, step int, vidx array<long>, beta array<double>, br double, brb double", path), "paths")
    lam = F.element_at(F.array(*map(F.lit, lambdas.tolist())), F.col("step") + 1)
    grid = found.groupBy("s", "step").agg(F.sum("br").alias("br"), F.sum("brb").alias("brb"), F.sum(F.size(F.filter("beta", lambda b: b != 0))).alias("n_nonzero"))
    grid = grid.select("s", "step", lam.alias("lambda"), F.when(F.col("brb") > 1e-12, F.col("br") / F.sqrt("brb")).otherwise(0.0).alias("score"), "n_nonzero")
    best = grid.filter("score <= 1").orderBy(F.desc("score"), "s", "step").limit(1).collect()  # one row
    if best:
        chosen = found.filter((F.col("s") == best[0].s) & (F.col("step") == best[0].step))
    else:
        chosen = found.filter((F.col("s") == s_seq[0]) & (F.col("step") == 0)).withColumn("beta", F.transform("beta", lambda b: F.lit(0.0)))
    return chosen.select(F.explode(F.arrays_zip("vidx", "beta")).alias("x")).select("x.vidx", "x.beta"), grid


# --- samplers that pool over all blocks ---------------------------------------------------------------


def _stream(seed: int, block_id: int) -> np.random.Generator:
    return np.random.default_rng([seed % (1 << 32), int(block_id)])


def _long(found: DataFrame, *names: str) -> DataFrame:
    """A row a variant from rows of blocks (start and an array for each name)."""
    rows = found.filter("start >= 0").select("start", F.posexplode(F.arrays_zip(*names)).alias("i", "x"))
    return rows.select((F.col("start") + F.col("i")).alias("vidx"), *(F.col(f"x.{n}").alias(n) for n in names))


def _answers(held, told: dict, pool, values: dict):
    """Rows of a task: one for each block with its part of the values, and from task 0 one of what all share (start -1)."""
    edges = np.cumsum([0, *(x.k for x in held)])
    rows = [{"start": x.start, **{n: v[a:b] for n, v in values.items()}, "told": None} for x, a, b in zip(held, edges, edges[1:], strict=False)]
    if getattr(pool, "rank", 0) == 0:
        rows.append({"start": -1, **{n: None for n in values}, "told": np.array(list(told.values()), np.float64)})
    return pd.DataFrame(rows, columns=["start", *values, "told"])


def _told(found: DataFrame) -> np.ndarray:
    return np.array(found.filter("start = -1").select("told").collect()[0].told)  # one row of a few numbers


POOLED = "start long, beta array<double>, told array<double>"


@_of_tables
def auto(blocks: DataFrame, effects: DataFrame, h2: float = 0.1, p: float = 0.1, burn_in: int = 200, num_iter: int = 200, seed: int = 1, shared: bool = True, **kw) -> tuple[DataFrame, dict]:
    """One chain that learns h2 and p: (effects, estimates). effects may have columns prior and slab.

    h2 and p are pooled over all blocks after each sweep; with shared off each block has its own, starting
    from its part of h2.
    """
    m, many = _total(blocks)
    extra = _optional(effects)
    if "prior" in extra and shared:
        raise ValueError("prior weights need fixed p (grid) or annotations (annot)")

    def run(held, pool):
        own = {c: _joined(held, c) for c in extra}
        options = {"burn_in": burn_in, "num_iter": num_iter, "rngs": [_stream(seed, x.block_id) for x in held], **own, **kw}
        decoded, beta, n = [decode(x) for x in held], _joined(held, "beta"), _joined(held, "n")
        if shared:
            c = kernels.sample(decoded, beta, n, h2, p, rng=np.random.default_rng(seed), pool=pool, m=m, **options)
            told = {"h2": float(np.mean(c.h2)), "p": float(np.mean(c.p))}
        else:
            c = kernels.sample(decoded, beta, n, h2, p, shared=False, **options)
            sizes = np.array([x.k for x in held], float)
            sums = pool(np.array([c.h2.mean(0).sum() if len(held) else 0.0, (c.p.mean(0) * sizes).sum() if len(held) else 0.0]))
            told = {"h2": sums[0], "p": sums[1] / max(m, 1)}
        yield _answers(held, told, pool, {"beta": c.beta})

    found = run_pooled(with_effects(blocks, effects, extra), many, POOLED, run)
    told = _told(found)
    return _long(found, "beta"), {"h2_est": float(told[0]), "p_est": float(told[1])}


INFERRED = ("h2_est", "h2_low", "h2_high", "p_est", "p_low", "p_high", "r2_est", "r2_low", "r2_high", "n_chains", "n_kept")


@_of_tables
def infer(blocks: DataFrame, effects: DataFrame, n_chains: int = 10, p_range=(1e-4, 0.2), h2: float = 0.1, burn_in: int = 200, num_iter: int = 200, sample_every: int = 5, seed: int = 1, **kw) -> tuple[DataFrame, DataFrame]:
    """(effects, one row of estimates with intervals) from several chains."""
    if n_chains < 2:
        raise ValueError("inference needs two chains or more")
    m, many = _total(blocks)

    def run(held, pool):
        decoded, beta, n = [decode(x) for x in held], _joined(held, "beta"), _joined(held, "n")
        chains = [
            kernels.sample(decoded, beta, n, float(h2), float(p), burn_in=burn_in, num_iter=num_iter, sample_every=sample_every, rng=np.random.default_rng(s), rngs=[_stream(s, x.block_id) for x in held], pool=pool, m=m, **kw)
            for p, s in zip(kernels.p_starts(n_chains, *p_range), kernels.chain_seeds(seed, n_chains), strict=True)
        ]
        told = kernels.infer(chains, decoded, pool=pool)
        yield _answers(held, {x: told[x] for x in INFERRED}, pool, {"beta": told["beta"]})

    found = run_pooled(with_effects(blocks, effects), many, POOLED, run)
    told = dict(zip(INFERRED, _told(found).tolist(), strict=True))
    row = tuple(int(told[x]) if x.startswith("n_") else told[x] for x in INFERRED)
    return _long(found, "beta"), blocks.sparkSession.createDataFrame([row], ", ".join(f"{x} {'long' if x.startswith('n_') else 'double'}" for x in INFERRED))


@_of_tables
def auto_rounds(blocks: DataFrame, effects: DataFrame, h2: float = 0.1, p: float = 0.1, rounds: int = 10, burn_rounds: int = 5, sweeps: int = 20, seed: int = 1) -> tuple[DataFrame, dict]:
    """Pooled h2 and p without a barrier stage, a job for each round: in each, every block makes `sweeps` sweeps at fixed values,
    then the causal share and b' R b of all blocks give the next."""
    m, _ = _total(blocks)
    rows = written(with_effects(blocks, effects), "rounds")
    state, path = None, []
    for r in range(burn_rounds + rounds):
        source = rows if state is None else rows.join(state.select("block_id", F.col("state").alias("e_state"), F.col("sum").alias("e_sum")), "block_id")

        def step(held, r=r, h2=h2, p=p):
            first = not hasattr(held[0], "e_state")
            decoded = [decode(x) for x in held]
            start = None if first else _joined(held, "state")
            earlier = np.zeros(sum(x.k for x in held)) if first else _joined(held, "sum")
            rngs = [np.random.default_rng([seed, int(x.block_id), r]) for x in held]
            c = kernels.sample(decoded, _joined(held, "beta"), _joined(held, "n"), h2, p, burn_in=0, num_iter=sweeps, rngs=rngs, m=m, learn_h2=False, learn_p=False, start=start, sample_every=max(1, sweeps - 1))
            last, kept = c.samples[-1].astype(np.float64), earlier + (c.beta if r >= burn_rounds else 0.0)
            edges = np.cumsum([0, *(x.k for x in held)])
            return pd.DataFrame([{"block_id": x.block_id, "start": x.start, "state": last[a:b], "sum": kept[a:b], "causal": float(c.pip[a:b].sum()), "variance": float(last[a:b] @ d.dot(last[a:b]))} for x, d, a, b in zip(held, decoded, edges, edges[1:], strict=False)])

        before, state = state, written(_by_blocks(source, "block_id long, start long, state array<double>, sum array<double>, causal double, variance double", step), "round")
        if before is not None:
            drop(before)
        total = state.agg(F.sum("causal").alias("c"), F.sum("variance").alias("v")).collect()[0]
        p = float(np.clip((1 + total.c) / (2 + m), 1e-6, 0.999))
        h2 = float(np.clip(total.v, 1e-4, 1.0))
        if r >= burn_rounds:
            path.append((h2, p))
    drop(rows)
    beta = _long(state.select("start", F.transform("sum", lambda x: x / rounds).alias("beta")), "beta")
    return beta, {"h2_est": float(np.mean([x for x, _ in path])), "p_est": float(np.mean([x for _, x in path]))}


@_of_tables
def annot(blocks: DataFrame, effects: DataFrame, names: list[str], seed: int = 1, **kw) -> tuple[DataFrame, dict]:
    """effects also hold the annotation columns. (effects, h2 and the enrichment of each annotation)."""
    _, many = _total(blocks)
    plain = {f"a{k}": n for k, n in enumerate(names)}  # names of files may not be names of fields
    renamed = effects.select("vidx", "beta", "n", *(F.col(n if "." not in n else f"`{n}`").alias(k) for k, n in plain.items()))

    def run(held, pool):
        a = np.column_stack([_joined(held, c) for c in plain])
        t = kernels.annotated([decode(x) for x in held], _joined(held, "beta"), _joined(held, "n"), a, seed=seed, rngs=[_stream(seed, x.block_id) for x in held], pool=pool, **kw)
        told = {"h2": t["h2"]} | {f"t{k}": x for k, x in enumerate(t["theta"])} | {f"f{k}": x for k, x in enumerate(t["phi"])}
        yield _answers(held, told, pool, {"beta": t["beta"]})

    found = run_pooled(with_effects(blocks, renamed, tuple(plain)), many, POOLED, run)
    told = _told(found)
    width = (len(told) - 1) // 2
    theta, phi = told[1 : 1 + width], told[1 + width :]
    enrichment = dict(zip(["intercept", *names] if width > len(names) else names, theta.tolist(), strict=True))
    return _long(found, "beta"), {"h2_est": float(told[0]), "enrichment": enrichment, "phi": phi.tolist()}


def top_enrichments(enrichment: dict[str, float], many: int = 8) -> list[tuple[str, float]]:
    """The annotations of the largest enrichments, either way."""
    return sorted(((k, v) for k, v in enrichment.items() if k != "intercept"), key=lambda x: -abs(x[1]))[:many]


@_of_tables
def bivariate(blocks: DataFrame, effects: DataFrame, seed: int = 1, **kw) -> tuple[DataFrame, dict]:
    """effects: vidx, beta, n and beta2, n2. (vidx, beta1, beta2) and h2_1, h2_2, rg, cov."""
    m, many = _total(blocks)

    def run(held, pool):
        t = kernels.bivariate([decode(x) for x in held], *(_joined(held, c) for c in ("beta", "beta2", "n", "n2")), seed=seed, rngs=[_stream(seed, x.block_id) for x in held], pool=pool, m=m, **kw)
        yield _answers(held, {x: t[x] for x in ("h2_1", "h2_2", "rg", "cov")}, pool, {"beta1": t["beta1"], "beta2": t["beta2"]})

    found = run_pooled(with_effects(blocks, effects, ("beta2", "n2")), many, "start long, beta1 array<double>, beta2 array<double>, told array<double>", run)
    return _long(found, "beta1", "beta2"), dict(zip(("h2_1", "h2_2", "rg", "cov"), _told(found).tolist(), strict=True))


@_of_tables
def impute(blocks: DataFrame, effects: DataFrame, ridge: float = 1e-3, min_r2: float = 0.0) -> DataFrame:
    """effects: vidx, beta, n, typed (1 or 0) for every variant: (vidx, beta, n, r2)."""

    def run(x):
        b, n, r2 = kernels.impute_block(decode(x).full(), np.nan_to_num(np.array(x.e_beta, float)), np.nan_to_num(np.array(x.e_n, float)), np.array(x.e_typed) > 0, ridge, min_r2)
        return pd.DataFrame({"vidx": _vidx(x), "beta": b, "n": n, "r2": r2})

    return _by_block(with_effects(blocks, effects, ("typed",)), "vidx long, beta double, n double, r2 double", run)


@_of_tables
def dentist(blocks: DataFrame, effects: DataFrame, cutoff: float = 29.716785, **kw) -> DataFrame:
    """(vidx, keep). cutoff: the chi-square value (1 degree of freedom; 29.72 is p = 5e-8)."""
    return _by_block(with_effects(blocks, effects, ("z",)), "vidx long, keep boolean", lambda x: pd.DataFrame({"vidx": _vidx(x), "keep": kernels.dentist(decode(x).full(), np.array(x.e_z), cutoff, **kw)}))


FINEMAPPED = "vidx long, block_id long, pip double, mean double, sd double, signal int, coverage double, purity_min double, purity_mean double"


@_of_tables
def finemap(blocks: DataFrame, effects: DataFrame, only_significant: float | None = None, coverage: float = 0.95, min_abs_corr: float = 0.5, max_signals: int = 10, **kw) -> DataFrame:
    """A row a variant: vidx, block_id, pip, mean, sd, and the credible set's number in its block (signal), coverage and purity, null outside.

    Blocks without a significant variant are filtered before they reach Python.
    """
    rows = with_effects(blocks, effects)
    if only_significant is not None:
        from statistics import NormalDist

        least = -NormalDist().inv_cdf(only_significant / 2)
        rows = rows.filter(F.exists(F.zip_with("e_beta", "e_n", lambda b, n: F.abs(b) * F.sqrt(n)), lambda z: z > least))

    def run(held):
        decoded, out = [decode(x) for x in held], []
        for x, block, t in zip(held, decoded, kernels.posterior_inclusions(decoded, _joined(held, "beta"), _joined(held, "n"), **kw), strict=True):
            signal, told = np.full(x.k, -1), np.zeros((3, x.k))
            for s in kernels.credible_sets(t["pip"], block.full(), coverage, min_abs_corr, max_signals):
                signal[s["members"]] = s["signal"]
                told[:, s["members"]] = np.array([s["coverage"], s["purity_min"], s["purity_mean"]])[:, None]
            out.append(pd.DataFrame({"vidx": _vidx(x), "block_id": x.block_id, "pip": t["pip"], "mean": t["mean"], "sd": t["sd"], "signal": signal.astype(np.int32), "coverage": told[0], "purity_min": told[1], "purity_mean": told[2]}))
        return pd.concat(out, ignore_index=True)

    found = _by_blocks(_dealt(rows, blocks), FINEMAPPED, run)
    inside = F.col("signal") >= 0
    return found.select("vidx", "block_id", "pip", "mean", "sd", *(F.when(inside, F.col(c)).alias(c) for c in ("signal", "coverage", "purity_min", "purity_mean")))


def credible_sets(found: DataFrame) -> DataFrame:
    """A row a credible set of finemap()'s rows that also have an id: block_id, signal, coverage, n_variants, lead_variant, lead_pip,
    purity_min, purity_mean, variants (ids by falling pip)."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("pip")).alias("p"), "vidx", "id")))
    sets = found.filter("signal is not null").groupBy("block_id", "signal").agg(F.first("coverage").alias("coverage"), F.count("*").alias("n_variants"), order.alias("x"), F.max("pip").alias("lead_pip"), F.first("purity_min").alias("purity_min"), F.first("purity_mean").alias("purity_mean"))
    return sets.select("block_id", "signal", "coverage", "n_variants", F.col("x")[0]["id"].alias("lead_variant"), "lead_pip", "purity_min", "purity_mean", F.transform("x", lambda y: y["id"]).alias("variants"))


def low_rank_blocks(blocks: DataFrame, variance: float = 0.99, max_rank: int | None = None, least: int = 0) -> DataFrame:
    """Blocks of `least` variants or more as low-rank factors."""

    def run(held):
        return pd.DataFrame([_encode(x.block_id, x.start, kernels.low_rank(decode(x).full(), variance, max_rank) if x.k >= least else decode(x)) for x in held])

    return _by_blocks(blocks, BLOCK, run)
