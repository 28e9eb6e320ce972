"""Linkage disequilibrium: blocks, their correlations, and what is computed from them.

A block is one row: (block_id, start, k, kind, payload). kind is dense (k * k singles), sparse (indptr, indices, data) or
lowrank (k * rank singles). Pair form, (block_id, i, j, r) with block-local i and j, serves SQL-shaped work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsloom.functions import kernels
from prsloom.functions.columns import complement

BLOCK = "block_id long, start long, k int, kind string, indptr binary, indices binary, data binary"


def block_bounds(variants: DataFrame, block_size: int = 500) -> DataFrame:
    """(vidx, block_id, place): runs of one chromosome in file order, cut every block_size.

    vidx is gapless, so a run starts where the variant before has another chromosome: an equi-join on vidx + 1. Runs, as
    many as chromosome changes, are then numbered in one small window and met by chromosome and range.
    """
    rows = _runs(variants)
    place = F.col("vidx") - F.col("first")
    block = F.col("first") + F.floor(place / block_size) * block_size  # a block is known by its first variant
    return rows.select("vidx", block.alias("block_id"), (place % block_size).alias("place"))


def _runs(variants: DataFrame) -> DataFrame:
    """(vidx, first): the first variant of each variant's run of one chromosome."""
    v = variants.select("vidx", "chrom")
    before = v.select((F.col("vidx") + 1).alias("vidx"), F.col("chrom").alias("_c"))
    starts = v.join(before, "vidx", "left").filter("_c is null or _c != chrom").select(F.col("vidx").alias("first"), F.col("chrom").alias("_chrom"))
    runs = starts.withColumn("until", F.lead("first").over(Window.orderBy("first")))
    rows = v.join(runs, (F.col("chrom") == F.col("_chrom")) & (F.col("vidx") >= F.col("first")) & (F.col("until").isNull() | (F.col("vidx") < F.col("until"))))
    return rows.select("vidx", "first")


def _encode(block_id: int, start: int, block) -> dict:
    row = {"block_id": block_id, "start": start, "k": block.size, "indptr": None, "indices": None}
    if isinstance(block, kernels.Sparse):
        return row | {"kind": "sparse", "indptr": block.indptr.astype(np.int32).tobytes(), "indices": block.indices.astype(np.int32).tobytes(), "data": block.data.tobytes()}
    if isinstance(block, kernels.LowRank):
        return row | {"kind": "lowrank", "data": block.u.tobytes()}
    return row | {"kind": "dense", "data": block.matrix.tobytes()}


def decode(row):
    """The kernel's block of a row (anything with the columns as attributes)."""
    data = np.frombuffer(row.data, np.float32)
    if row.kind == "sparse":
        return kernels.Sparse(np.frombuffer(row.indptr, np.int32), np.frombuffer(row.indices, np.int32), data, row.k)
    if row.kind == "lowrank":
        return kernels.LowRank(data.reshape(row.k, -1))
    return kernels.Dense(data.reshape(row.k, row.k))


def _standardized(frame: pd.DataFrame) -> np.ndarray:
    """Dosages of a group's variants in order: mean 0, sd 1 over all samples, 0 where missing or without variation."""
    g = np.array([np.asarray(x, np.float64) for x in frame["dosage"]])
    missing = np.isnan(g)
    n = np.maximum((~missing).sum(1, keepdims=True), 1)
    mean = np.where(missing, 0, g).sum(1, keepdims=True) / n
    z = np.where(missing, 0, g - mean)
    sd = np.sqrt((z * z).mean(1, keepdims=True))
    return np.divide(z, sd, out=np.zeros_like(z), where=sd > 1e-12)


def _gram(ridge, kind, threshold, max_dist, variance, max_rank, least):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vidx")
        z = _standardized(frame)
        r = (1 - ridge) * (z @ z.T / z.shape[1])
        np.fill_diagonal(r, 1.0)
        block = kernels.Dense(r)
        if kind == "sparse":
            block = kernels.sparsify(r, threshold, max_dist)
        elif kind == "lowrank" and len(r) >= least:
            block = kernels.low_rank(r, variance, max_rank)
        return pd.DataFrame([_encode(int(frame["block_id"].iloc[0]), int(frame["vidx"].iloc[0]), block)])

    return run


def compute_blocks(geno: DataFrame, bounds: DataFrame, ridge: float = 0.0, kind: str = "dense", threshold: float = 1e-3, max_dist: int | None = None, variance: float = 0.99, max_rank: int | None = None, least: int = 0) -> DataFrame:
    """One row a block: correlations of standardised dosages, a Gram matrix in each group."""
    rows = geno.join(bounds.select("vidx", "block_id"), "vidx")
    return rows.groupBy("block_id").applyInPandas(_gram(ridge, kind, threshold, max_dist, variance, max_rank, least), BLOCK)


def pairs(blocks: DataFrame) -> DataFrame:
    """(block_id, start, i, j, r) with i and j in the block."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                r = decode(row).full()
                i, j = np.nonzero(r) if row.kind == "sparse" else np.indices(r.shape).reshape(2, -1)
                yield pd.DataFrame({"block_id": row.block_id, "start": row.start, "k": row.k, "i": i.astype(np.int32), "j": j.astype(np.int32), "r": r[i, j]})

    return blocks.mapInPandas(run, "block_id long, start long, k int, i int, j int, r double")


def ridged(p: DataFrame, ridge: float) -> DataFrame:
    return p.withColumn("r", F.when(F.col("i") == F.col("j"), 1.0).otherwise((1 - ridge) * F.col("r")))


def shrunk(p: DataFrame, n_ref: float, max_shrink: float = 0.5, intensity: float = 1.0) -> DataFrame:
    a = F.least(F.lit(float(max_shrink)), intensity * F.col("k") / n_ref)
    return p.withColumn("r", F.when(F.col("i") == F.col("j"), 1.0).otherwise((1 - a) * F.col("r")))


def sparsified(p: DataFrame, threshold: float = 1e-3, max_dist: int | None = None, shrink: float = 1.0) -> DataFrame:
    near = F.abs(F.col("r")) >= threshold
    if max_dist is not None:
        near = near & (F.abs(F.col("i") - F.col("j")) <= max_dist)
    return p.filter((F.col("i") == F.col("j")) | near).withColumn("r", F.when(F.col("i") == F.col("j"), F.col("r")).otherwise(F.col("r") * shrink))


def shrink_blocks(blocks: DataFrame, n_ref: float, max_shrink: float = 0.5, intensity: float = 1.0) -> DataFrame:
    def run(frames):
        for frame in frames:
            yield pd.DataFrame([_encode(x.block_id, x.start, kernels.shrunk(decode(x), n_ref, max_shrink, intensity)) for x in frame.itertuples(index=False)])

    return blocks.mapInPandas(run, BLOCK)


def with_effects(blocks: DataFrame, effects: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row a block, with its effects as arrays in order."""
    spans = blocks.select("block_id", "start", "k").withColumn("vidx", F.explode(F.expr("sequence(start, start + k - 1)"))).select("block_id", "vidx")
    names = ("beta", "n", *extra)
    e = effects.select("vidx", *names)
    rows = spans.join(e, "vidx").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("vidx", *names))).alias("e"))
    return blocks.join(rows, "block_id").select(*blocks.columns, *(F.col(f"e.{c}").cast("array<double>").alias(f"e_{c}") for c in names))


def ld_scores(blocks: DataFrame, n_ref: float | None = None) -> DataFrame:
    """(vidx, ld_score): sum of r squared, less its chance part where the panel's size is given. Summed where the block lies."""

    def run(frames):
        for frame in frames:
            for x in frame.itertuples(index=False):
                block = decode(x)
                if isinstance(block, kernels.Sparse):
                    each, many = np.bincount(block.rows(), block.data.astype(np.float64) ** 2, x.k), np.diff(block.indptr)
                elif isinstance(block, kernels.LowRank):
                    u = block.u.astype(np.float64)
                    each, many = np.einsum("kr,rs,ks->k", u, u.T @ u, u), np.full(x.k, x.k)
                else:
                    each, many = (block.full() ** 2).sum(1), np.full(x.k, x.k)
                yield pd.DataFrame({"vidx": x.start + np.arange(x.k), "ld_score": each if n_ref is None else each - (many - each) / (n_ref - 2)})

    return blocks.mapInPandas(run, "vidx long, ld_score double")


def cut_costs(p: DataFrame) -> DataFrame:
    """(block_id, cut, cost): squared correlation that a cut before each place would sever.

    A pair (i, j) counts at cuts i + 1 to j: plus at i + 1, minus at j + 1, and a running sum.
    """
    d = p.filter("i < j").select("block_id", "k", (F.col("r") * F.col("r")).alias("q"), "i", "j")
    steps = d.select("block_id", "k", (F.col("i") + 1).alias("cut"), F.col("q").alias("d")).union(d.select("block_id", "k", (F.col("j") + 1).alias("cut"), (-F.col("q")).alias("d")))
    at = steps.groupBy("block_id", "k", "cut").agg(F.sum("d").alias("d"))
    run = Window.partitionBy("block_id").orderBy("cut")
    return at.withColumn("cost", F.sum("d").over(run)).filter("cut < k").select("block_id", "cut", "cost")


def optimal_blocks(blocks: DataFrame, max_size: int, min_size: int = 1, window: int | None = None) -> DataFrame:
    """(block_id, start, size): each row's variants cut anew where the least correlation is lost."""

    def run(frames):
        for frame in frames:
            for x in frame.itertuples(index=False):
                sizes = kernels.optimal_cuts(decode(x).full(), max_size, min_size, window)
                yield pd.DataFrame({"block_id": x.block_id, "start": x.start + np.r_[0, np.cumsum(sizes)[:-1]], "size": np.array(sizes, np.int32)})

    return blocks.mapInPandas(run, "block_id long, start long, size int")


def _cut_steps(window: int):
    """From a tile and its right neighbour: where pairs of the tile's variants start and stop to be severed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        z, place = _standardized(frame), frame["place"].to_numpy()
        left = np.flatnonzero(frame["own"].to_numpy())
        first, steps = place[0] if len(place) else 0, np.zeros(len(place) + 1)
        for a in range(0, len(left), 256):
            i = left[a : a + 256]
            q = (z[i] @ z.T / z.shape[1]) ** 2
            ahead = place[None, :] - place[i][:, None]
            q[(ahead <= 0) | (ahead > window)] = 0.0
            # a pair (i, j) counts at cuts i + 1 to j
            np.add.at(steps, i + 1, q.sum(1))
            steps[1:] -= q.sum(0)
        return pd.DataFrame({"first": frame["first"].iloc[0], "cut": first + np.arange(len(steps)), "d": steps})

    return run


def optimal_split(geno: DataFrame, variants: DataFrame, max_size: int, min_size: int = 1, window: int | None = None) -> DataFrame:
    """(vidx, block_id, place) like block_bounds: each run of a chromosome is cut where the least squared correlation, of
    pairs up to `window` variants apart, is lost.

    Correlations are banded: a tile of `window` variants meets itself and its right neighbour. What the tiles report are numbers
    by cut, and the dynamic program over a chromosome holds one number for each of its variants.
    """
    window = window or max_size
    placed = _runs(variants).withColumn("place", F.col("vidx") - F.col("first"))
    tiles = placed.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("tile", F.floor(F.col("place") / window) - F.when(F.col("own"), 0).otherwise(1)).filter("tile >= 0")
    steps = geno.join(tiles, "vidx").groupBy("first", "tile").applyInPandas(lambda frame: _cut_steps(window)(frame), "first long, cut long, d double")
    costs = steps.groupBy("first", "cut").agg(F.sum("d").alias("d"))
    sizes = placed.groupBy("first").agg(F.count("*").alias("m"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        m = int(frame["m"].iloc[0])
        cost = np.zeros(m + 1)
        inside = frame["cut"].to_numpy() <= m
        cost[frame["cut"].to_numpy()[inside]] = frame["d"].to_numpy()[inside]
        found = kernels.best_cuts(np.cumsum(cost), max_size, min_size)
        return pd.DataFrame({"block_id": frame["first"].iloc[0] + np.r_[0, np.cumsum(found)[:-1]], "size": np.array(found, np.int64)})

    cut = costs.join(sizes, "first").groupBy("first").applyInPandas(best, "block_id long, size long")
    return cut.select(F.explode(F.expr("sequence(block_id, block_id + size - 1)")).alias("vidx"), "block_id").withColumn("place", F.col("vidx") - F.col("block_id"))


def partition_h2(blocks: DataFrame, effects: DataFrame) -> DataFrame:
    """(block_id, h2): b' R b of each block. effects: vidx, beta."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([{"block_id": x.block_id, "h2": float(np.asarray(x.e_beta) @ decode(x).dot(np.asarray(x.e_beta)))} for x in frame.itertuples(index=False)])

    return with_effects(blocks, effects.withColumn("n", F.lit(0.0))).mapInPandas(run, "block_id long, h2 double")


def block_diagonal(blocks: DataFrame) -> DataFrame:
    """(i, j, r) of the whole matrix, by variant; pairs of different blocks are not stored."""
    return pairs(blocks).select((F.col("start") + F.col("i")).alias("i"), (F.col("start") + F.col("j")).alias("j"), "r")


# --- blocks kept for later runs -------------------------------------------------------------------------


def variant_key() -> Column:
    """What a variant is known by: its id, or its place where it has none."""
    known = F.coalesce(~F.col("id").isin("", "."), F.lit(False))
    return F.when(known, F.col("id")).otherwise(F.concat_ws(":", F.col("chrom"), F.col("pos").cast("string")))


def save(blocks: DataFrame, variants: DataFrame, path: str) -> None:
    """Blocks with the key and the alleles of each of their variants, in order. variants: vidx, id, chrom, pos, a1, a2."""
    spans = blocks.select("block_id", F.explode(F.expr("sequence(start, start + k - 1)")).alias("vidx"))
    own = variants.select("vidx", variant_key().alias("key"), F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))
    listed = spans.join(own, "vidx").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("vidx", "key", "a1", "a2"))).alias("x"))
    out = blocks.join(listed, "block_id", "left").select(*blocks.columns, *(F.col(f"x.{c}").alias(c) for c in ("key", "a1", "a2")))
    bad = blocks.join(listed, "block_id", "left").filter("x is null or size(x) != k").limit(1).count()
    if bad:
        raise ValueError("the variants are not those of the blocks")
    again = own.join(spans, "vidx", "left_semi").groupBy("key").count().filter("count > 1").limit(3).collect()
    if again:
        raise ValueError(f"blocks are kept by variant id, and ids are repeated: {', '.join(x.key for x in again)}")
    out.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{BLOCK}, key array<string>, a1 array<string>, a2 array<string>").parquet(path)


def align(kept: DataFrame, variants: DataFrame) -> DataFrame:
    """(vidx in the kept blocks, file_vidx, sign) for every variant of kept blocks; sign -1 where the alleles stand the other way round.

    variants: vidx, id, chrom, pos, a1, a2 of this run. Raises where a kept variant is not among them, or has other alleles.
    """
    held = kept.select("start", F.posexplode(F.arrays_zip("key", "a1", "a2")).alias("i", "x")).select((F.col("start") + F.col("i")).alias("vidx"), F.col("x.key").alias("key"), F.col("x.a1").alias("c1"), F.col("x.a2").alias("c2"))
    first = F.min(F.struct(F.col("vidx").alias("v"), F.upper("a1").alias("a1"), F.upper("a2").alias("a2"))).alias("y")
    own = variants.groupBy(variant_key().alias("key")).agg(first)
    both = held.join(own, "key", "left").select("vidx", "key", "c1", "c2", F.col("y.v").alias("file_vidx"), F.col("y.a1").alias("a1"), F.col("y.a2").alias("a2"))
    b1, b2 = complement(F.col("a1")), complement(F.col("a2"))
    same = ((F.col("a1") == F.col("c1")) & (F.col("a2") == F.col("c2"))) | ((b1 == F.col("c1")) & (b2 == F.col("c2")))
    turned = ((F.col("a1") == F.col("c2")) & (F.col("a2") == F.col("c1"))) | ((b1 == F.col("c2")) & (b2 == F.col("c1")))
    out = both.withColumn("sign", F.when(same, 1.0).when(turned, -1.0))
    bad = out.filter("sign is null")
    many = bad.count()
    if many:
        raise ValueError(f"the LD cache has {many} variants that are absent here, or have other alleles (such as {', '.join(x.key for x in bad.orderBy('vidx').limit(3).collect())}): the inputs or the quality control have changed, build it again")
    return out.select("vidx", "file_vidx", "sign")
