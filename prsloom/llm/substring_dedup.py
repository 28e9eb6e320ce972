"""Substring dedup by a count-min prefilter and an exact second pass.

1. Every task hashes the anchors of its windows into sparse cells of a count-min sketch whose
   counters saturate at two ("once", "more"). A window's anchor is the least of the hashes of its
   shorter sub-windows, so it is a function of the window's words: windows with equal words have
   equal anchors, and an anchor that occurs once belongs to windows that occur once. Counting
   anchors in place of windows makes the sketch about five times smaller.
2. The sparse cells are shuffled by block and merged as a stream. What remains is one bit a cell
   ("more than once"), at most ROWS * 2**width_bits / 8 bytes (32 MB by default) whatever the
   corpus: that proven bound is why it may be broadcast. A sketch only overestimates; a corpus
   that fills it makes the second pass group more windows, never fewer.
3. The second pass emits the windows that the sketch estimates repeated, grouped exactly by two
   independent 64-bit hashes. Each Arrow batch sends a window once: repeats within a batch are
   known to be repeats there and travel as merged intervals. The first start of each window, by
   (doc_id, start), stays; all others cover words that go.
4. The covered intervals, gathered by document, meet the texts in one join.

Input cases: a null or empty text has no words; rows without an id come before all ids, each text for itself; rows
that share a doc_id are judged as one document, so what is cut from one is cut from all, and
exact repeats of a row each return the same result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_column, gather_runs, keyed, mix, pieces, row_of, run_hash, shuffle_width, text_bytes, word_hashes, word_spans

WINDOW = 20
#: Words of a sub-window whose least hash is its window's anchor.
ANCHOR = 12
ROWS = 2
WIDTH_BITS = 27
BLOCK_BITS = 16
_SECOND = 0xC2B2AE3D27D4EB4F


def anchors(words: np.ndarray, word_off: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the word at which each one's anchor starts, and the hash of the
    anchor that starts at each word."""
    n = len(words)
    row = row_of(word_off)
    at = np.arange(n - window + 1) if n >= window else np.zeros(0, np.int64)
    at = at[row[at] == row[at + window - 1]]
    subs = run_hash(words, np.arange(n - anchor + 1), np.arange(anchor, n + 1)) if n >= anchor else np.zeros(0, np.uint64)
    if not len(at):
        return at, at, subs
    best, place = subs[at], at.copy()
    for k in range(1, window - anchor + 1):
        other = subs[at + k]
        less = other < best
        best = np.where(less, other, best)
        place[less] = at[less] + k
    return at, place, subs


def cells(hashes: np.ndarray, width_bits: int) -> list[np.ndarray]:
    """The cell in each row of the sketch."""
    mask = np.uint64((1 << width_bits) - 1)
    return [((mix(hashes + np.uint64(r * _SECOND & (1 << 64) - 1)) & mask) + np.uint64(r << width_bits)).astype(np.int64) for r in range(ROWS)]


def _sketch(window: int, anchor: int, width_bits: int):
    low = (1 << BLOCK_BITS) - 1

    def emit(found):
        for cell in map(np.concatenate, zip(*found, strict=True)):
            cell.sort()
            new = np.r_[True, cell[1:] != cell[:-1]]
            at = np.flatnonzero(new)
            many = np.diff(np.r_[at, len(cell)]) > 1
            cell = cell[at]
            block = cell >> BLOCK_BITS
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            value = (cell & low).astype(np.uint16)
            heads = block[cut[:-1]]
            columns = []
            for keep in (~many, many):
                before = np.r_[0, np.cumsum(keep)]
                columns.append(binary_column(value[keep], before[cut]))
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), *columns], ["block", "once", "more"])

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for piece in pieces(batch):
                data, off = text_bytes(piece.column("text"))
                starts, ends, word_off = word_spans(data, off)
                _, place, subs = anchors(word_hashes(data, starts, ends), word_off, window, anchor)
                if len(place):
                    hashes = subs[np.unique(place)]
                    found.append(cells(hashes, width_bits))
                    size += len(hashes)
            if size > 2_000_000:
                yield from emit(found)
                found, size = [], 0
        if found:
            yield from emit(found)

    return run


def _merge(batches):
    width = 1 << BLOCK_BITS
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            state = seen.setdefault(block, np.zeros((2, width // 8), np.uint8))
            bits = np.zeros(width, bool)
            bits[np.frombuffer(once, np.uint16)] = True
            packed = np.packbits(bits)
            bits[:] = False
            bits[np.frombuffer(more, np.uint16)] = True
            twice = np.packbits(bits)
            state[1] |= twice | (state[0] & packed)
            state[0] |= packed | twice
    rows = [(block, state[1].tobytes()) for block, state in seen.items() if state[1].any()]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["block", "bits"])


def repeated_cells(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width_bits: int = WIDTH_BITS) -> np.ndarray:
    """The merged sketch: one bit a cell, set where the estimate is two or more."""
    spark = docs.sparkSession
    merged = (
        docs.select("text")
        .mapInArrow(_sketch(window, anchor, width_bits), "block long, once binary, more binary")
        .repartition(shuffle_width(spark), "block")
        .mapInArrow(_merge, "block long, bits binary")
    )
    out = np.zeros(ROWS << (width_bits - 3), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for block, bits in merged.collect():  # at most ROWS * 2**(width_bits - 3) bytes in all
        out[block * step : (block + 1) * step] = np.frombuffer(bits, np.uint8)
    return out


def _candidates(sketch, window: int, anchor: int, width_bits: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("known", pa.bool_())])

    def found(piece, bits):
        data, off = text_bytes(piece.column("text"))
        starts, ends, word_off = word_spans(data, off)
        words = word_hashes(data, starts, ends)
        at, place, subs = anchors(words, word_off, window, anchor)
        if not len(at):
            return None
        picked, back = np.unique(place, return_inverse=True)
        twice = np.ones(len(picked), bool)
        for cell in cells(subs[picked], width_bits):
            twice &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        at = at[twice[back]]
        if not len(at):
            return None
        row = row_of(word_off)[at]
        keys = piece.column("key").to_numpy()
        return run_hash(words, at, at + window), run_hash(words, at, at + window, _SECOND), keys[row], at - word_off[row]

    def run(batches):
        bits = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            parts = [x for x in (found(p, bits) for p in pieces(batch)) if x is not None]
            if not parts:
                continue
            h1, h2, key, start = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((start, key, h2, h1))
            h1, h2, key, start = h1[order], h2[order], key[order], start[order]
            head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            later = (key != key[lead]) | (start != start[lead])
            yield pa.RecordBatch.from_arrays([pa.array(h1[head].view(np.int64)), pa.array(h2[head].view(np.int64)), pa.array(key[head]), pa.array(start[head].astype(np.int32)), pa.array(np.full(int(head.sum()), window, np.int32)), pa.array(np.zeros(int(head.sum()), bool))], schema=schema)
            if later.any():
                key, start = key[later], start[later]
                order = np.lexsort((start, key))
                key, start = key[order], start[order]
                cut = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + window)]
                first = np.flatnonzero(cut)
                last = np.r_[first[1:], len(cut)] - 1
                n = len(first)
                spread = mix(key[first].astype(np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(n, np.int64)), pa.array(key[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + window - start[first]).astype(np.int32)), pa.array(np.ones(n, bool))], schema=schema)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width_bits: int = WIDTH_BITS) -> DataFrame:
    """(key, spans): for each document the word runs that windows starting earlier elsewhere cover, each start << 32 | length."""
    rows = keyed(docs, True).select("key", "text")
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(rows, window, anchor, width_bits).tobytes())
    emitted = rows.mapInArrow(_candidates(sketch, window, anchor, width_bits), "h1 long, h2 long, key long, start int, length int, known boolean")
    first = F.min(F.when(~F.col("known"), F.struct("key", "start"))).over(Window.partitionBy("h1", "h2"))
    return (
        emitted.withColumn("first", first)
        .filter(F.col("known") | (F.struct("key", "start") > F.col("first")))
        .groupBy("key")
        .agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("length")).alias("spans"))
    )


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                data, off = text_bytes(piece.column("text"))
                starts, ends, word_off = word_spans(data, off)
                lists = piece.column("spans")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                per_row = np.asarray(lists.value_lengths().fill_null(0))
                row = np.repeat(np.arange(piece.num_rows), per_row)
                size = np.diff(word_off)
                a = np.minimum(flat >> 32, size[row])
                b = np.minimum((flat >> 32) + (flat & 0xFFFFFFFF), size[row])
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, word_off[row] + a, 1)
                np.add.at(depth, word_off[row] + b, -1)
                # a run that ends with its row closes at the next row's first word, where it is balanced
                keep = np.cumsum(depth)[:-1] == 0
                removed = np.r_[0, np.cumsum(~keep)]
                # kept words, each with a space after it
                at = np.flatnonzero(keep)
                length = ends[at] - starts[at]
                spaced = np.append(data, np.uint8(32))
                index = gather_runs(starts[at], length + 1)
                closing = np.cumsum(length + 1) - 1
                index[closing] = len(data)
                joined = spaced[index] if len(index) else np.zeros(0, np.uint8)
                words_before = np.r_[0, np.cumsum(keep)][word_off]
                bytes_before = np.r_[0, closing + 1][words_before]
                raw = joined.tobytes()
                kept = [raw[x : max(x, y - 1)] for x, y in zip(bytes_before[:-1], bytes_before[1:], strict=True)]
                columns = [piece.column("doc_id"), pa.array(size.astype(np.int64)), pa.array((removed[word_off[1:]] - removed[word_off[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True, width_bits: int = WIDTH_BITS) -> DataFrame:
    """Documents without the words that repeat an earlier window of `window` words.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text.
    """
    spans = repeated_spans(docs, window, min(ANCHOR, window), width_bits)
    joined = keyed(docs, True).join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
