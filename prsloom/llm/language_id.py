"""Language identification by a linear-chain conditional random field over words.

Every word is labelled, so that code-switched texts show where they switch: a word scores each
language by hashed features (its prefixes and suffixes, inner character n-grams, and itself as a
lexicon entry), transitions between the words' languages are learned, and forward-backward gives
each word's probabilities. A document's language is the one with the largest share of its
words; its score is that share.

Learning: at most SAMPLE documents of each language, chosen by a hash of id and text (a documented
bound: a classifier's quality does not grow with the corpus), whole texts. The hash is even, so a language's count gives the
value up to which about half as many again lie; the SAMPLE smallest of these are taken. Runs of different documents are spliced
into training sequences, which gives the transitions switches to learn from. Maximum likelihood by Adam over the exact gradient,
in one task: the driver sees the weights, not the texts.

Input cases: a null text or one without letters is `und` with score 0; documents without lang teach nothing; with
no labelled document everything is `und`; a null doc_id counts as held out = false and is returned as null; repeated
rows each get the same answer; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chains
from .common import gather_runs, pieces, row_of, run_hasher, text_bytes, word_hashes, word_spans

SAMPLE = 200
BITS = 16
EPOCHS = 30
#: Words whose probabilities training holds at once.
PART_WORDS = 40_000
#: Bytes or features that training takes at once, and words whose features' weights are held at once.
PART_BYTES = 1 << 18
SCORED = 5_000
UNKNOWN = "und"
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    upper = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
    low[upper] += 32
    return low


def features(low: np.ndarray, hasher, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of words, one word after another, and how many each has. hasher: of the bytes of low."""
    size = ends - starts
    mask = np.uint64((1 << BITS) - 1)
    kinds = []
    for k in (1, 2, 3):
        kinds.append((k, starts, np.minimum(starts + k, ends)))
    for k in (1, 2, 3, 4):
        kinds.append((10 + k, np.maximum(ends - k, starts), ends))
    kinds.append((20, starts, ends))
    n = len(starts)
    fixed = np.stack([hasher(a, b) ^ np.uint64(int(tag) * _SEEDS[0] & (1 << 64) - 1) for tag, a, b in kinds], 1) if n else np.zeros((0, 8), np.uint64)
    grams = [fixed.reshape(-1)]
    word = [np.repeat(np.arange(n), fixed.shape[1])]
    for k in (2, 3):
        many = np.maximum(size - k + 1, 0)
        at = gather_runs(starts, many)
        value = np.zeros(len(at), np.uint64)
        for j in range(k):
            value = value * np.uint64(257) + low[at + j]
        grams.append((value + np.uint64(k)) * np.uint64(_SEEDS[k - 1]))
        word.append(np.repeat(np.arange(n), many))
    word, grams = np.concatenate(word), np.concatenate(grams)
    order = np.argsort(word, kind="stable")
    return ((grams[order] >> np.uint64(20)) & mask).astype(np.int64), np.bincount(word, minlength=n)


def byte_hasher(low: np.ndarray):
    return run_hasher(low.astype(np.uint64) + np.uint64(1))


def emissions(weights: np.ndarray, buckets: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Each word's score for each language."""
    out = np.zeros((len(many), weights.shape[1]))
    ends = np.cumsum(many)
    for a in range(0, len(many), SCORED):
        to, size = ends[a : a + SCORED], many[a : a + SCORED]
        at = to[0] - size[0]
        out[a : a + SCORED] = np.add.reduceat(weights[buckets[at : to[-1]]], to - size - at, axis=0)
    return out


def distinct(data: np.ndarray, off: np.ndarray):
    """(low, starts, ends) of each distinct word, the word number of each word, offsets of rows."""
    low = lowered(data)
    starts, ends, word_off = word_spans(data, off)
    _, first, back = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    return low, starts[first], ends[first], back, word_off


def vocabulary(data: np.ndarray, off: np.ndarray):
    """As distinct(), with the bytes of distinct words alone, hashed a part at a time."""
    low = lowered(data)
    starts, ends, word_off = word_spans(data, off)
    hashes = np.zeros(len(starts), np.uint64)
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(low), PART_BYTES)), len(starts)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = starts[a]
        hashes[a:b] = word_hashes(low[at : ends[b - 1]], starts[a:b] - at, ends[a:b] - at)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    ends_of = np.cumsum(size)
    return low[gather_runs(starts[first], size)], ends_of - size, ends_of, back, word_off


def lettered(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words hold a letter (any character beyond ASCII counts here)."""
    seen = np.r_[0, np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128))]
    return seen[ends] > seen[starts]


def train(texts: list[str], labels: np.ndarray, n_labels: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and log transitions."""
    data, off = text_bytes(pa.array(texts, pa.large_string()))
    low, starts, ends, back, word_off = vocabulary(data, off)
    hasher = byte_hasher(low)
    parts = [features(low, hasher, starts[a : a + SCORED], ends[a : a + SCORED]) for a in range(0, len(starts), SCORED)]
    buckets = np.concatenate([np.zeros(0, np.uint16), *(x.astype(np.uint16) for x, _ in parts)])
    many = np.concatenate([np.zeros(0, np.int64), *(x for _, x in parts)])
    del parts
    owner = np.repeat(np.arange(len(many), dtype=np.int32), many)
    # splice runs of different documents: a sequence takes turns of 4 to 40 words
    rng = np.random.default_rng(7)
    turns = [(d, a, min(a + int(rng.integers(4, 41)), int(word_off[d + 1]))) for d in range(len(texts)) for a in range(int(word_off[d]), int(word_off[d + 1]), 40)]
    rng.shuffle(turns)
    word, gold, lengths = [], [], []
    for at in range(0, len(turns), 4):
        some = turns[at : at + 4]
        for d, a, b in some:
            word.append(back[a:b])
            gold.append(np.full(b - a, labels[d]))
        lengths.append(sum(b - a for _, a, b in some))
    weights = np.zeros((1 << BITS, n_labels))
    moves = np.eye(n_labels) * 2.0
    if not word or not sum(lengths):
        return weights, moves
    word, gold, lengths = np.concatenate(word), np.concatenate(gold), np.array(lengths)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(word), bool)
    inner[first] = False
    wanted_moves = np.zeros((n_labels, n_labels))
    np.add.at(wanted_moves, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    start = np.full(n_labels, 1 / n_labels)
    # sequences are gone through some at a time, so that memory does not follow the lengths of the texts
    ends = np.cumsum(lengths)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PART_WORDS, ends[-1], PART_WORDS)), len(lengths)])
    memory = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for epoch in range(1, epochs + 1):
        each = emissions(weights, buckets, many)
        by_word, xi = np.zeros((len(many), n_labels)), np.zeros((n_labels, n_labels))
        for u, v in zip(cuts[:-1], cuts[1:], strict=True):
            here = slice(first[u], ends[v - 1])
            score = each[word[here]]
            x = np.exp(np.maximum(score - score.max(1, keepdims=True), -40))
            gamma, counted, _ = chains.posteriors(x, np.exp(moves), start, lengths[u:v])
            # the virtual step from start to the first word is no transition
            entry = np.exp(moves) * start[:, None]
            xi += counted - (entry / entry.sum(0)) * gamma[first[u:v] - first[u]].sum(0)[None, :]
            error = -gamma
            error[np.arange(len(error)), gold[here]] += 1
            for k in range(n_labels):
                by_word[:, k] += np.bincount(word[here], error[:, k], len(many))
        by_bucket = np.zeros((n_labels, 1 << BITS))
        for a in range(0, len(buckets), PART_BYTES):
            at, of = buckets[a : a + PART_BYTES].astype(np.int64), owner[a : a + PART_BYTES]
            for k in range(n_labels):
                np.add.at(by_bucket[k], at, by_word[of, k])
        g = by_bucket.T / len(word) - 1e-6 * weights
        gm = (wanted_moves - xi) / len(word)
        for value, grad, m, v in ((weights, g, memory[0], memory[1]), (moves, gm, memory[2], memory[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    return weights, moves


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions from documents that are not held out."""
    top = 1 << 40
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(top)).alias("h"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a language
    if not counts:
        return [], np.zeros((1 << BITS, 0)), np.zeros((0, 0))
    chosen = F.lit(False)
    for lang, n in sorted(counts):
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= int(top * min(1.0, 1.5 * sample / n))))
    # copies of a row are one; about 1.5 * sample texts a language meet in one task
    drawn = labelled.filter(chosen).groupBy("lang", "h").agg(F.min("text").alias("text")).coalesce(1)
    found = drawn.select("lang", "h", "text").mapInArrow(_learn(sample), "languages array<string>, weights binary, moves binary").collect()
    if not found:
        return [], np.zeros((1 << BITS, 0)), np.zeros((0, 0))
    languages, weights, moves = found[0]
    n = len(languages)
    return languages, np.frombuffer(weights, np.float32).reshape(-1, n), np.frombuffer(moves).reshape(n, n)


def _learn(sample: int):
    """From all of (lang, h, text), the sample smallest h of each language: one row with languages, weights and transitions."""

    def run(batches):
        drawn = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True)]
        drawn.sort()
        rows = [row for _, own in itertools.groupby(drawn, lambda row: row[0]) for row in itertools.islice(own, sample)]
        if rows:
            languages = sorted({x[0] for x in rows})
            weights, moves = train([x[2] for x in rows], np.array([languages.index(x[0]) for x in rows]), len(languages))
            yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([moves.tobytes()], pa.binary())], ["languages", "weights", "moves"])

    return run


def _label(languages: list[str], shared, moves: np.ndarray, accept: float | None = None):
    """Adds the answer to each row; with accept, gives the rows themselves whose score is at least that."""
    step = np.exp(moves)
    start = np.full(len(languages), 1 / max(1, len(languages)))

    def run(batches):
        weights = shared.value
        for batch in batches:
            for piece in pieces(batch, limit=1 << 20):
                data, off = text_bytes(piece.column("text"))
                low, starts, ends, back, word_off = distinct(data, off)
                n = piece.num_rows
                counts = np.diff(word_off)
                letters = lettered(low, starts, ends)[back]
                row = row_of(word_off)
                has = np.bincount(row[letters], minlength=n)
                share = np.zeros((n, len(languages)))
                switches = np.zeros(n, np.int64)
                if len(back) and languages:
                    score = np.zeros((len(starts), len(languages)))
                    hasher = byte_hasher(low)
                    for a in range(0, len(starts), 20_000):
                        score[a : a + 20_000] = emissions(weights, *features(low, hasher, starts[a : a + 20_000], ends[a : a + 20_000]))
                    score[~lettered(low, starts, ends)] = 0
                    x = np.exp(np.maximum(score - score.max(1, keepdims=True), -40))[back]
                    gamma = chains.posteriors(x, step, start, counts)[0]
                    for k in range(len(languages)):
                        share[:, k] = np.bincount(row[letters], gamma[letters, k], n)
                    best = gamma.argmax(1)
                    switches = np.bincount(row[1:][(best[1:] != best[:-1]) & (row[1:] == row[:-1])], minlength=n)
                total = share.sum(1)
                told = (has > 0) & (total > 0)
                # words beyond ASCII counted as lettered above: make sure of texts that have no ASCII letter
                ascii_letters = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
                for k in np.flatnonzero(told & (ascii_letters[off[1:]] == ascii_letters[off[:-1]])):
                    told[k] = any(c.isalpha() for c in piece.column("text")[int(k)].as_py() or "")
                top = share.argmax(1) if languages else np.zeros(n, np.int64)
                value = np.where(told, share.max(1, initial=0) / np.where(total > 0, total, 1), 0.0)
                names = [languages[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), told.tolist(), strict=True)]
                if accept is not None:
                    yield from pa.Table.from_batches([piece]).filter(pa.array(told & (value >= accept))).to_batches()
                    continue
                columns = [c for c in piece.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(names, pa.string()), pa.array(np.clip(value, 0, 1)), pa.array(counts.astype(np.int64)), pa.array(switches.astype(np.int64))], [*columns, "lang_pred", "score", "n_words", "n_switches"])

    return run


def identify(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches (changes of language between words)."""
    languages, weights, moves = model or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers a language
    return rows.mapInArrow(_label(languages, shared, moves), "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def accepted(docs: DataFrame, least: float = 0.5, model: tuple | None = None) -> DataFrame:
    """The documents, all columns, that have letters and of whose words the likeliest language has a share of least or more."""
    languages, weights, moves = model or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_label(languages, shared, moves, least), docs.schema)
