"""Shared folders, intermediate tables and NumPy kernels over Arrow text columns."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsloom.tables import drop, scratch, shared_dir, written  # noqa: F401

#: Null ids stand as this key in joins and come first in id order.
NULL_ID = -(1 << 63)
#: Where rows without an id are kept apart, their keys lie below this one; ids do not.
LEAST_ID = -(1 << 62)
#: Bytes of text that a kernel holds expanded at once (a longer text is taken alone).
PIECE_BYTES = 2 << 20


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, apart: bool = False) -> DataFrame:
    """(key, doc_id, text): all that the operators use of documents; other columns are left alone.

    Rows without an id share one key, or with apart have one for each text.
    """
    text = F.col("text").cast("string")
    none = F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(text), 2) if apart else F.lit(NULL_ID)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def known_id(column: str) -> Column:
    """A key as an id, null for rows without one."""
    return F.when(F.col(column) >= LEAST_ID, F.col(column))


def digest() -> Column:
    """Beside doc_id, what a row is known by: rows of equal id and text get equal decisions."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own beside the table's, whatever those are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Copies of the smaller side that a common key of a join is dealt over.
SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "left") -> DataFrame:
    """A join in which rows of many that share a key are dealt over SALTS tasks, by a column; few has a row a key."""
    (salt,) = fresh(many, "salt")
    left = many.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)))
    right = few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*on, salt], how).drop(salt)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__.setdefault("found", {})


# --- text kernels -----------------------------------------------------------------------------

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES):
    """Slices of a batch, each of at most limit bytes of a text or binary column, or of one row."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = text_bytes(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    cache = worker_cache()
    found = cache.get(("powers", base))
    if found is None or len(found) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        found = cache[("powers", base)] = np.cumprod(out, dtype=np.uint64)
        if len(found) > 1 << 23:  # a very long text must not leave its table behind
            del cache[("powers", base)]
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hasher(values: np.ndarray, base: int = _BASE):
    """A function of (starts, ends): a mixed 64-bit hash of values[start:end] for each pair, by polynomial prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n, base), dtype=np.uint64, out=sums[1:])
    inverse = powers(n + 1, pow(base, -1, 1 << 64))

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return hashes


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    return run_hasher(values, base)(starts, ends)


def byte_table(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; lower gives A-Z the values of a-z."""
    table = np.array([(x * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & M64 for x in range(1, 257)], np.uint64)
    table = mix(table)
    if lower:
        table[65:91] = table[97:123]
    return table


SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and n + 1 offsets of rows into them.

    inside: for each byte whether it belongs to a word; by default all but ASCII white space.
    """
    if inside is None:
        inside = np.ones(256, bool)
        inside[list(SPACES)] = False
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    here, before = word[1:], word[:-1]
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return run_hash(byte_table(lower)[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def row_of(word_off: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each run, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of a NumPy array as a binary column; offsets are in items."""
    data = np.ascontiguousarray(values)
    at = (np.asarray(offsets, np.int64) * data.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
