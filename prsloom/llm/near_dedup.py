"""Near-duplicate groups by an inverted join over MinHash coordinates.

1. Every document gets the set of its distinct word shingles, a MinHash signature of SIGNATURE
   coordinates and a 128-bit hash of the set. Documents with equal sets form a class; only the
   class's smallest id goes on.
2. Documents are posted under each (coordinate, value). Two documents whose sets are alike enough
   share MATCHES coordinates or more but for a chance of about 1 in a million. Ordered from rare to
   common, their first SIGNATURE - MATCHES + 1 postings (the prefix) then meet: only these lists
   are merged, and common lists are skipped unless a document has nothing rarer. A set of up to SMALL
   shingles is its own signature, every shingle a coordinate: the threshold is then exact and the prefix far shorter,
   so that short documents do not meet over a line that they share. Sets a little larger are posted both ways, as they can
   be alike to either.
3. Each list proposes its smallest document against all others: as many pairs as postings, however
   long the list. Pairs with MATCHES or more are confirmed on the full sets and merged
   into components. Every list is then split by the sizes of the sets: sizes fall into bands, each as
   wide as two sets that are alike enough can differ, so a band only meets itself and the next one. Parts
   whose documents are all merged by now are skipped. Of the other parts,
   pairs across components are counted on the signatures, long parts block by block, and those
   at or over the threshold are confirmed: the most alike for each pair of document and component
   first, then those that still lie across components. So no link between components is lost, while a
   list of n copies costs about n, not n * n.
4. Pairs are confirmed on texts. Only the texts of documents in pairs are shuffled: a bitmap of the pairs' ids, of
   2**ID_BITS bits (8 MB) whatever the corpus, is broadcast to the scan. A bit that others share lets a text through in
   vain, never holds one back.

Components come from min-label propagation with pointer jumping over tables in the shared folder; nothing of
it is collected.

Input cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words
than a shingle count as one shingle; rows without an id are judged each by its own text, come before all ids, and their ids are
returned as null; rows that share an id are one document in near_duplicates(), while without_near_duplicates() judges every row by its own
text and leaves one of equal rows; an empty table gives an empty result; extra columns are ignored, or kept by
without_near_duplicates(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, keyed, known_id, mix, pieces, row_of, run_hash, text_bytes, word_hashes, word_spans, written

SHINGLE = 5
PERCENT = 80
SIGNATURE = 64
#: Of 64 coordinates, two sets of likeness 0.8 share fewer than 35 once in about 800,000 times.
MATCHES = 35
#: Sets of up to so many shingles are posted under their shingles, larger ones under signature coordinates.
SMALL = 64
#: Bits of the map of a whole set: bounds what two sets can share from above, tightly up to about a thousand shingles.
BITS = 8192
#: Lists longer than this are cut into blocks of about as many documents.
BLOCK = 1024
#: Bits of the map of the ids in pairs, as a power of two.
ID_BITS = 26
#: Pairs that each document of an open list proposes in each round; None is all of them.
ROUNDS = (2, None)


def sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and n + 1 offsets of rows."""
    starts, ends, word_off = word_spans(data, off)
    words = word_hashes(data, starts, ends, lower=True)
    row = row_of(word_off)
    size = np.diff(word_off)
    n = len(words)
    at = np.arange(max(0, n - shingle + 1))
    at = at[row[at] == row[at + shingle - 1]] if len(at) else at
    short = np.flatnonzero((size > 0) & (size < shingle))
    rows = np.concatenate([row[at], short])
    hashes = run_hash(words, np.concatenate([at, word_off[short]]), np.concatenate([at + shingle, word_off[short + 1]])) if n else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(len(off)))


def _sign(shingle: int, coordinates: int, percent: int):
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=2 << 20):
                hashes, cut = sets(*text_bytes(piece.column("text")), shingle)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                signature = np.zeros((piece.num_rows, coordinates), np.uint32)
                sums = np.zeros((2, piece.num_rows), np.uint64)
                if len(full):
                    at = cut[:-1][full]
                    for c in range(coordinates):
                        signature[full, c] = np.minimum.reduceat(((hashes ^ masks[c]) * factors[c]) >> np.uint64(32), at)
                    sums[0, full] = np.add.reduceat(mix(hashes + np.uint64(1)), at)
                    sums[1, full] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                bits = []
                for a in range(0, piece.num_rows, 1024):
                    b = min(a + 1024, piece.num_rows)
                    seen = np.zeros((b - a, BITS), bool)
                    seen[row_of(cut[a : b + 1]), (mix(hashes[cut[a] : cut[b]] + np.uint64(2)) & np.uint64(BITS - 1)).astype(np.int64)] = True
                    bits += [x.tobytes() for x in np.packbits(seen, axis=1)]
                own = [hashes[a:b].tobytes() if 100 * SMALL >= percent * (b - a) else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in signature], pa.binary()), pa.array(bits, pa.binary()), pa.array(own, pa.binary())],
                    ["key", "n", "h1", "h2", "signature", "bits", "own"],
                )

    return run


def _post(least: int, percent: int):
    """(cv, rep, way, total, prefix, n): the postings of each document by coordinates (way 0) or by shingles (way 1)."""

    def rows(cv, rep, way, total, prefix, n):
        return pa.RecordBatch.from_arrays([pa.array(cv), pa.array(rep), pa.array(np.full(len(cv), way, np.int8)), pa.array(total.astype(np.int32)), pa.array(prefix.astype(np.int32)), pa.array(n)], ["cv", "rep", "way", "total", "prefix", "n"])

    def run(batches):
        for batch in batches:
            rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            large = np.flatnonzero(n > SMALL)
            if len(large):
                values = np.array([np.frombuffer(x, np.uint32) for x in batch.column("signature").take(pa.array(large)).to_pylist()], np.int64)
                many = values.shape[1]
                cv = (values + (np.arange(many, dtype=np.int64) << 32)).reshape(-1)
                yield rows(cv, np.repeat(rep[large], many), 0, np.full(len(cv), many), np.full(len(cv), many - least + 1), np.repeat(n[large], many))
            small = np.flatnonzero(100 * SMALL >= percent * n)
            if len(small):
                cv = np.concatenate([np.frombuffer(x, np.int64) for x in batch.column("own").take(pa.array(small)).to_pylist()])
                size = n[small]
                yield rows(cv, np.repeat(rep[small], size), 1, np.repeat(size, size), np.repeat(size - (percent * size + 99) // 100 + 1, size), np.repeat(size, size))

    return run


def _matches(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.array([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("way"), pa.array((a == b).sum(1).astype(np.int32))], ["a", "b", "way", "matches"])


def _confirm(shingle: int, percent: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "ta", 1 << 20):
                (ha, ca), (hb, cb) = (sets(*text_bytes(piece.column(c)), shingle) for c in ("ta", "tb"))
                na, nb = np.diff(ca), np.diff(cb)
                rows = np.concatenate([row_of(ca), row_of(cb)])
                hashes = np.concatenate([ha, hb])
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])], minlength=piece.num_rows)
                linked = pa.array((100 * both >= percent * (na + nb - both)) & (both > 0))
                yield pa.RecordBatch.from_arrays([piece.column("a").filter(linked), piece.column("b").filter(linked)], ["a", "b"])

    return run


#: What names a block of a list, or a pair of them.
PART = ["way", "cv", "band", "i", "j"]


def _across(least: int, percent: int, best: int | None):
    """From rows sorted by block: pairs that lie in different components and match often enough; with best, only so many
    for each document, the most alike."""

    def pairs(block: pd.DataFrame) -> np.ndarray:
        # side 0 meets side 1; a block with itself is on both
        side = block["own"].to_numpy() == block["i"].iloc[0]
        both = block["i"].iloc[0] == block["j"].iloc[0]
        sig = np.array([np.frombuffer(x, np.uint32) for x in block["signature"]])
        bits = np.array([np.frombuffer(x, np.uint64) for x in block["bits"]])
        rep, comp, n, low = (block[c].to_numpy() for c in ("rep", "comp", "n", "low"))
        lost = n - np.bitwise_count(bits).sum(1)  # shingles that share a bit with another of their set
        left = np.arange(len(block)) if both else np.flatnonzero(side)
        right = left if both else np.flatnonzero(~side)
        out = []
        for a in range(0, len(left), 64):
            x = left[a : a + 64]
            ok = (comp[x][:, None] != comp[right][None]) & ~(low[x][:, None] & low[right][None]) & (100 * np.minimum(n[x][:, None], n[right][None]) >= percent * np.maximum(n[x][:, None], n[right][None]))
            if best is None and both:
                ok &= rep[x][:, None] < rep[right][None]
            r, c = np.nonzero(ok)
            same = (sig[x[r]] == sig[right[c]]).sum(1)
            keep = (same >= least) | (block["way"].iloc[0] == 1)  # shingles of their own are exact: signatures have no say
            r, c, same = r[keep], c[keep], same[keep]
            # what two sets share leaves a bit in both maps but for those lost in either: a bound from above
            u, v = x[r], right[c]
            both_have = [np.bitwise_count(bits[u[k : k + 4096]] & bits[v[k : k + 4096]]).sum(1) for k in range(0, len(u), 4096)]
            most = np.concatenate([np.zeros(0, np.int64), *both_have]) + np.minimum(lost[u], lost[v])
            keep = 100 * most >= percent * (n[u] + n[v] - most)
            r, c, same = r[keep], c[keep], same[keep]
            if best is not None:
                order = np.lexsort((rep[right[c]], -same, r))
                r, c, same = r[order], c[order], same[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < best
                r, c, same = r[keep], c[keep], same[keep]
            out.append(np.stack([rep[x[r]], rep[right[c]], same]))
        return np.concatenate(out, 1)

    def told(found: list[np.ndarray]) -> pd.DataFrame:
        x = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        x = np.unique(np.stack([np.minimum(x[0], x[1]), np.maximum(x[0], x[1]), x[2]]), axis=1)
        return pd.DataFrame({"a": x[0], "b": x[1], "matches": x[2].astype(np.int32)})

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            new = frame[PART].ne(frame[PART].shift()).any(axis=1).to_numpy()
            cut = np.flatnonzero(new)
            rest = frame.iloc[cut[-1] :] if len(cut) else None  # the last block may go on in the next frame
            yield told([pairs(frame.iloc[u:v]) for u, v in zip(cut[:-1], cut[1:], strict=True)])
        if rest is not None and len(rest):
            yield told([pairs(rest)])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), for each node with an edge."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), name)
    while True:
        known = label.select("node", "comp")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = known.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        # a label's own label is at most the label: jump to it
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = written(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), name)
        changed = after.filter("was != comp").limit(1).count()
        drop(label)
        label = after
        if not changed:
            drop(both)
            return label.select("node", "comp")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, text) of the documents in pairs (a, b), and of few others."""
    placed = lambda rows, key: rows.withColumn("place", F.pmod(F.xxhash64(key), F.lit(1 << ID_BITS)) + 1)
    ids = placed(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key")
    maps = ids.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    # at most 2**ID_BITS / 32768 rows of 4 KB
    rows = placed(keyed(docs, True).select("key", "text"), "key").withColumn("bucket", F.bitmap_bucket_number("place")).withColumn("bit", F.bitmap_bit_position("place").cast("int"))
    there = F.expr("shiftright(cast(conv(hex(substring(map, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) & 1 = 1")
    return rows.join(F.broadcast(maps), "bucket").filter(there).select("key", "text")


def links(docs: DataFrame, classes: DataFrame, lists: DataFrame, shingle: int, percent: int, least: int) -> DataFrame:
    """(node, comp) over classes; lists are (way, cv, rep, n) of their prefixes."""
    sign = classes.select("rep", "n", "signature", "bits")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        texts = written(texts_of(docs, pairs), f"{name}-texts")
        left = pairs.select("a", "b").hint("shuffle_hash").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        right = left.hint("shuffle_hash").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        return written(right.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, percent), "a long, b long"), name)

    heads = lists.groupBy("way", "cv").agg(F.min("rep").alias("a"), F.count("*").alias("many")).filter("many > 1")
    stars = lists.join(heads, ["way", "cv"]).filter("rep != a").groupBy("a", F.col("rep").alias("b")).agg(F.max("way").alias("way"))
    a = sign.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    b = sign.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    near = stars.join(a, "a").join(b, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    alike = near.select("a", "b", "way", "sa", "sb").mapInArrow(_matches, "a long, b long, way byte, matches int").filter((F.col("matches") >= least) | (F.col("way") == 1))
    edges = confirmed(written(alike.select("a", "b"), "alike"), "links-1")
    label = components(edges)
    # a little wider than the sizes of two sets that are alike enough, so that rounding parts none
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100.1 / percent)).cast("int")
    banded = lists.select("way", "cv", "rep", band.alias("own_band"))

    for number, best in enumerate(ROUNDS, 2):
        placed = banded.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        # each band's part also holds the band below it
        placed = placed.withColumn("low", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", F.col("own_band") + F.col("low").cast("int")).drop("own_band")
        ends = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"), F.bool_and("low").alias("below")]
        open_lists = placed.groupBy("way", "cv", "band").agg(*ends).filter("lo != hi and not below").select("way", "cv", "band", "many")
        rest = placed.join(open_lists, ["way", "cv", "band"]).join(sign, "rep")
        # long parts are cut into blocks, and each pair of blocks is dealt out as one
        blocks = F.ceil(F.col("many") / BLOCK).cast("int")
        dealt = rest.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("way", "cv", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "low", "rep", "comp", "n", "signature", "bits")
        ordered = dealt.repartition(*PART).sortWithinPartitions(*PART)
        pending = written(ordered.mapInPandas(_across(least, percent, best), "a long, b long, matches int").select("a", "b").distinct(), "pending")
        if pending.limit(1).count() == 0:
            break
        edges = edges.union(confirmed(pending, f"links-{number}"))
        label = components(edges)
    return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = SIGNATURE, least: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document that stays for its group)."""
    signed = written(keyed(docs, True).select("key", "text").mapInArrow(_sign(shingle, coordinates, percent), "key long, n long, h1 long, h2 long, signature binary, bits binary, own binary"), "signatures")
    classes = written(signed.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("key", "signature", "bits", "own")).alias("x")).select("h1", "h2", "n", F.col("x.key").alias("rep"), "x.signature", "x.bits", "x.own"), "classes")
    posted = classes.select("rep", "n", "signature", "own").mapInArrow(_post(least, percent), "cv long, rep long, way byte, total int, prefix int, n long")
    frequent = posted.groupBy("way", "cv").agg(F.count("*").alias("df")).filter("df > 1")
    # postings of one document alone come first in its order and meet nothing: the rest of the prefix is what is left
    shared = posted.join(frequent, ["way", "cv"]).groupBy("rep", "way", "total", "prefix", "n").agg(F.array_sort(F.collect_list(F.struct("df", "cv"))).alias("x"))
    room = F.col("prefix") - (F.col("total") - F.size("x"))
    lists = written(shared.filter(room > 0).select("rep", "way", "n", F.explode(F.slice("x", F.lit(1), room)).alias("p")).select("way", "p.cv", "rep", "n"), "prefixes")
    label = links(docs, classes, lists, shingle, percent, least)
    grouped = signed.join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left").withColumn("rep", F.coalesce("rep", "key"))
    out = grouped.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    return out.select(known_id("key").alias("doc_id"), F.col("n").alias("n_shingles"), known_id("comp").alias("component_id"), (F.col("key") == F.col("comp")).alias("kept"), "key")


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document, the one with the smallest id, of each group; of rows that share an id, or have none, each stands for itself."""
    row, kept, again = fresh(docs, "row", "kept", "again")
    ids = docs.groupBy(F.col("doc_id").cast("long").alias(kept)).agg(F.count("*").alias(again)).filter(f"`{again}` > 1 or `{kept}` is null")
    shared = written(ids.select(kept, F.lit(True).alias(again)), "shared-ids")
    # a key of the row's own where the id is not: below all ids, by id and text
    own = F.lit(-(1 << 61)) - F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), 3)
    marked = docs.join(shared, F.col("doc_id").cast("long").eqNullSafe(F.col(kept)), "left").withColumn(row, F.when(F.col(again), own).otherwise(F.col("doc_id").cast("long"))).drop(kept)
    found = near_duplicates(marked.select(F.col(row).alias("doc_id"), "text"), shingle, percent).filter("kept").select(F.col("key").alias(kept))
    left = marked.join(found, F.col(row) == F.col(kept), "left_semi")
    # of equal rows one stays; these are only among rows that share an id
    once = left.filter(F.col(again).isNull()).unionByName(left.filter(again).dropDuplicates([row]))
    return once.select(docs.columns)
