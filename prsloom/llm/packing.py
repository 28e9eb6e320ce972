"""Best-two-fit packing of token sequences.

Only lengths decide how documents are packed, and a length is at most the capacity: the corpus
counts as a histogram with one count for each length, which bounds what the driver holds. The
driver packs the histogram, a pattern of lengths at a time, repeated as often as the counts allow:
fill the bin greedily with the longest lengths that still fit, then look whether the bin's
smallest document should give way to two unpacked ones that fill its expanded gap more tightly.
Executors then deal the pieces out: a piece's rank among those of its length, from its rank in its
task and a running sum over tasks, names its pattern, copy and slot.

Input cases: a null or empty text is the end id alone; a null doc_id stays null; rows that share a
doc_id are packed as documents of their own; an empty table packs into nothing; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written
from .tokens import END_ID, encoded

CAPACITY = 4096


def pack(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(copies, lengths) of each pattern. counts[n]: pieces of length n; the last is the capacity."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    number = np.arange(capacity + 1)
    out = []
    while left[1:].any():
        free = left.copy()
        longest = np.maximum.accumulate(np.where(free > 0, number, 0))  # longest length at most n that is left
        lengths, gap = [], capacity
        while gap and (n := int(longest[gap])):
            take = int(min(free[n], gap // n))
            lengths += [n] * take
            gap -= n * take
            free[n] -= take
            if free[n] == 0:
                longest = np.maximum.accumulate(np.where(free > 0, number, 0))
        if gap and len(lengths) > 1:
            smallest = lengths[-1]
            room = gap + smallest
            first = np.flatnonzero(free[: room + 1])
            if len(first):
                second = longest[room - first]
                same = (second == first) & (free[first] < 2)
                second = np.where(same, longest[np.maximum(np.minimum(first - 1, room - first), 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    lengths = [*lengths[:-1], *sorted((int(first[best]), int(second[best])), reverse=True)]
        kinds, used = np.unique(lengths, return_counts=True)
        copies = int((left[kinds] // used).min())
        left[kinds] -= copies * used
        out.append((copies, lengths))
    return out


def _pieces(capacity: int, vocabulary: str | None, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for piece, ids, counts in encoded(batches, vocabulary, end_id):
            raw = ids.astype("<u4").tobytes()
            begin = np.cumsum(counts) - counts
            n_pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n_pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (begin[row] + start).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
            # rank among the task's pieces of the same length
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - first + met[ordered]
            met += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def _deal(patterns: list[tuple[int, list[int]]], capacity: int):
    """Arrays, by length, of where each pattern's slots for it begin."""
    slots: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    filled = [0] * (capacity + 1)
    base = 0
    for copies, lengths in patterns:
        offsets = np.cumsum([0, *lengths[:-1]])
        by: dict[int, list[int]] = {}
        for n, at in zip(lengths, offsets.tolist(), strict=True):
            by.setdefault(n, []).append(at)
        for n, ats in by.items():
            slots.setdefault(n, []).append((filled[n], base, np.array(ats)))
            filled[n] += copies * len(ats)
        base += copies

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else []
            for at, to in itertools.pairwise([*cut, len(ordered)]):
                rows = order[at:to]
                own = slots[int(ordered[at])]
                starts = np.array([x[0] for x in own])
                which = np.searchsorted(starts, rank[rows], "right") - 1
                many = np.array([len(x[2]) for x in own])
                first = np.cumsum(many) - many
                within = rank[rows] - starts[which]
                sequence[rows] = np.array([x[1] for x in own])[which] + within // many[which]
                offset[rows] = np.concatenate([x[2] for x in own])[first[which] + within % many[which]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = written(keyed(docs).select("doc_id", "text").mapInArrow(_pieces(capacity, vocabulary, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    tasks = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in found.groupBy("length").agg(F.count("*")).collect():  # at most capacity rows
        counts[n] = many
    before = tasks.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    ranked = found.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_deal(pack(counts), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
