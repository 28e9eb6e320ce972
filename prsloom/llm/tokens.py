"""Tokenizing with a public vocabulary, and a token file of frequency-ranked ids.

The format: ids are replaced by their rank in the corpus (0 the most frequent) and each rank
takes 1 to 4 whole bytes, low byte first. The byte counts stand apart, two bits each and four to
a control byte, so that a decoder looks up four lengths at once in a 256-row table and gathers
the bytes with NumPy, without a branch per id. A document's control bytes start at a new byte.
A file is a folder with two Parquet tables, committed by Spark's own writer on any file system:
`ranks` (rank, id, count) and `blocks`, whose rows hold consecutive documents in ascending
doc_id order: (part, block) is the order, `before` the ids of the part's earlier blocks.

Input cases: a null or empty text has the end id alone; a null doc_id comes first (and is written
as the least 64-bit integer); rows that share a doc_id each stand in the file, ordered by their
length and coded bytes; an empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SPACES, gather_runs, keyed, pieces, shared_dir, shuffle_width, text_bytes, word_hashes, word_spans, worker_cache, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Documents' ids in a block of the file, about.
BLOCK_IDS = 1 << 20
#: Distinct segments whose ids a worker remembers.
REMEMBERED = 1_500_000


class WordTokenizer:
    """Ids of texts by the tokenizers library, asking it once for each distinct segment.

    Only for vocabularies whose tokens never hold white space, that ignore case and split where
    letters meet punctuation: a text's ids are then those of its segments, one after another. A segment
    is a run of Latin letters (ASCII or Latin-1, in lower case) or of ASCII punctuation within a word;
    a word that holds anything else is one segment as it stands. Segments are found and
    looked up by 64-bit hashes in NumPy.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.kinds = np.full(256, 3, np.uint8)  # 0 white space, 1 letters, 2 punctuation, 3 other
        self.kinds[list(SPACES)] = 0
        for c in range(0x21, 0x7F):
            x = chr(c)
            self.kinds[c] = 1 if x.isalpha() else 3 if x.isdigit() or x in "'<" else 2
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros(0, np.int64)  # of each hash, its segment
        self.offsets = np.array([0, 1])  # segment 0 is the end of a text
        self.flat = np.array([self.end_id], np.uint32)

    def segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to look up, starts, ends, and n + 1 offsets of rows into segments."""
        kind = self.kinds[data]
        starts, ends, _ = word_spans(data, off)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        if len(lead):
            after = data[lead + 1]
            fine = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
            kind[lead[fine]] = kind[lead[fine] + 1] = 1
            upper = lead[fine & (after <= 0x9E)] + 1
            low[upper] += 32
        odd = np.r_[0, np.cumsum(kind == 3)]
        weird = odd[ends] > odd[starts]
        raw = gather_runs(starts[weird], ends[weird] - starts[weird])
        low[raw] = data[raw]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        word = np.searchsorted(starts, cut, "right") - 1
        cut = cut[~weird[word] & (cut != starts[word])] if len(cut) else cut
        begin = np.sort(np.concatenate([starts, cut]))
        finish = ends[np.searchsorted(starts, begin, "right") - 1] if len(begin) else begin
        finish = np.minimum(finish, np.r_[begin[1:], len(data)]) if len(begin) else finish
        return low, begin, finish, np.searchsorted(begin, off)

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        found = []
        for at in range(0, len(texts), 5000):
            some = [x.decode("utf-8", "replace") for x in texts[at : at + 5000]]
            found += [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        first = len(self.offsets) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        at = np.searchsorted(self.hashes, hashes)  # the new ones come sorted
        self.hashes, self.place = np.insert(self.hashes, at, hashes), np.insert(self.place, at, first + np.arange(len(found)))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and the number of ids of each text."""
        low, begin, finish, row_off = self.segments(data, off)
        hashes, first, back = np.unique(word_hashes(low, begin, finish), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > REMEMBERED + len(hashes) * (len(self.hashes) == 0):
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            raw = low.tobytes()
            self.learn(hashes[new], [raw[a:b] for a, b in zip(begin[first[new]].tolist(), finish[first[new]].tolist(), strict=True)])
        index = self.place[np.searchsorted(self.hashes, hashes)][back] if len(hashes) else np.zeros(0, np.int64)
        index = np.insert(index, row_off[1:], 0)
        lengths = self.offsets[index + 1] - self.offsets[index]
        total = np.r_[0, np.cumsum(lengths)]
        return self.flat[gather_runs(self.offsets[index], lengths)], np.diff(total[row_off + np.arange(len(row_off))])


def tokenizer(path: str | None, end_id: int) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cache = worker_cache()
    if ("tokenizer", path, end_id) not in cache:
        cache["tokenizer", path, end_id] = WordTokenizer(path, end_id)
    return cache["tokenizer", path, end_id]


def encoded(batches, path: str | None, end_id: int):
    """(piece of a batch, ids, counts) for all text of an iterator of batches."""
    own = tokenizer(path, end_id)
    for batch in batches:
        for piece in pieces(batch, limit=2 << 20):
            yield piece, *own.encode(*text_bytes(piece.column("text")))


# --- the coding ---------------------------------------------------------------------------------

#: Lengths in bytes of the four numbers under each control byte.
LENGTHS = np.array([[(control >> 2 * k & 3) + 1 for k in range(4)] for control in range(256)], np.uint8)


def code(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of rows of unsigned numbers, and both counts by row."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    n_control = (counts + 3) // 4
    slots = np.zeros(int(n_control.sum()) * 4, np.uint8)
    first = np.cumsum(n_control) - n_control
    slots[gather_runs(first * 4, counts)] = size - 1
    four = slots.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    ends = np.cumsum(size)
    starts = ends - size
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        have = size > k
        if not have.any():
            break
        data[starts[have] + k] = values[have] >> np.uint32(8 * k) & np.uint32(0xFF)
    total = np.r_[0, ends]
    cut = np.r_[0, np.cumsum(counts)]
    return control, data, n_control, np.diff(total[cut])


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers that code() was given."""
    n_control = (counts + 3) // 4
    first = np.cumsum(n_control) - n_control
    size = LENGTHS[control].reshape(-1)[gather_runs(first * 4, counts)].astype(np.int64)
    starts = np.cumsum(size) - size
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    out = padded[starts]
    for k in range(1, 4):
        have = size > k
        if not have.any():
            break
        out[have] |= padded[starts[have] + k] << np.uint32(8 * k)
    return out


# --- the file -----------------------------------------------------------------------------------


def _encode(path, end_id):
    def run(batches):
        for piece, ids, counts in encoded(batches, path, end_id):
            raw = ids.astype("<u4").tobytes() if len(ids) and ids.max() > 0xFFFF else ids.astype("<u2").tobytes()
            width = len(raw) // max(1, len(ids))
            cut = np.r_[0, np.cumsum(counts)] * width
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(np.full(len(counts), width, np.int8)), pa.array([raw[a:b] for a, b in itertools.pairwise(cut.tolist())], pa.binary())], ["key", "width", "ids"])

    return run


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x, "<u2" if w == 2 else "<u4") for w, x in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.uint32), np.array([len(x) for x in rows], np.int64)


def _count(batches):
    total = np.zeros(1, np.int64)
    for piece in (p for batch in batches for p in pieces(batch, "ids", 2 << 20)):
        found = np.bincount(_ids(piece)[0])
        if len(found) > len(total):
            total = np.r_[total, np.zeros(len(found) - len(total), np.int64)]
        total[: len(found)] += found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "count"])


def _code(rank: np.ndarray):
    def run(batches):
        for batch in (p for whole in batches for p in pieces(whole, "ids", 2 << 20)):
            ids, counts = _ids(batch)
            control, data, n_control, n_data = code(rank[ids], counts)
            a, b = np.r_[0, np.cumsum(n_control)].tolist(), np.r_[0, np.cumsum(n_data)].tolist()
            control, data = control.tobytes(), data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts), pa.array([control[x:y] for x, y in itertools.pairwise(a)], pa.binary()), pa.array([data[x:y] for x, y in itertools.pairwise(b)], pa.binary())], ["key", "n", "control", "data"])

    return run


BLOCKS = "part int, block int, before long, n_ids long, n_docs int, keys binary, counts binary, control binary, data binary"


def _block(batches):
    part, block, before = TaskContext.get().partitionId(), 0, 0
    keys, counts, control, data, n = [], [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([n]), pa.array([len(keys)], pa.int32()), pa.array([np.array(keys, "<i8").tobytes()]), pa.array([np.array(counts, "<u4").tobytes()]), pa.array([b"".join(control)]), pa.array([b"".join(data)])],
            ["part", "block", "before", "n_ids", "n_docs", "keys", "counts", "control", "data"],
        )

    for batch in batches:
        for k, m, c, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys.append(k), counts.append(m), control.append(c), data.append(d)
            n += m
            if n >= BLOCK_IDS:
                yield row()
                block, before = block + 1, before + n
                keys, counts, control, data, n = [], [], [], [], 0
    if keys:
        yield row()


def write_token_file(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of all documents, the end id after each, as a token file at path."""
    spark = docs.sparkSession
    ids = written(keyed(docs).select("key", "text").mapInArrow(_encode(vocabulary, end_id), "key long, width byte, ids binary"), "ids")
    # at most one row for each id of the vocabulary
    counts = sorted(((-c, i) for i, c in ids.select("width", "ids").mapInArrow(_count, "id long, count long").groupBy("id").agg(F.sum("count")).collect()))
    rank = np.zeros(max([i for _, i in counts], default=0) + 1, np.uint32)
    for r, (_, i) in enumerate(counts):
        rank[i] = r
    spark.createDataFrame([(r, i, -c) for r, (c, i) in enumerate(counts)], "rank int, id int, count long").coalesce(1).write.parquet(f"{path}/ranks")
    coded = ids.mapInArrow(_code(rank), "key long, n long, control binary, data binary")
    ordered = coded.repartitionByRange(shuffle_width(spark), "key").sortWithinPartitions("key", "n", "control", "data")
    ordered.mapInArrow(_block, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _read(ranks: np.ndarray, starts: dict[int, int], with_ids: bool):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                keys = np.frombuffer(r["keys"], "<i8")
                ids = ranks[decode(np.frombuffer(r["control"], np.uint8), np.frombuffer(r["data"], np.uint8), counts)]
                cut = np.r_[0, np.cumsum(counts)]
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(cut.tolist())]
                columns = [pa.array(keys, mask=keys == NULL_ID), pa.array(starts[r["part"]] + r["before"] + cut[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, ids."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ranks = np.array([x.id for x in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    starts, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()):  # a row for each file
        starts[part], total = total, total + n
    return blocks.mapInArrow(_read(ranks, starts, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What op3 returns: a token file in the shared folder, read back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, path)
    return read_token_file(spark, path, with_ids=False)
