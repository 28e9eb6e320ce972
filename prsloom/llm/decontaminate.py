"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Native: DataFrame functions only. The hash set of the benchmark's windows is a map of bytes, two of which are set for each
window; it travels with the plan. Its size follows the number of windows up to MAP_BYTES, which bounds what is broadcast: a
benchmark of more than BAND windows is dealt by hash into bands, each with its own map and its own scan. Every document's
windows are hashed and looked up where the text lies. Only windows that the map holds go on (and about one in a thousand others):
they are verified, word by word, by a join with the benchmark's windows, which are broadcast if few, or dealt over several tasks, as
one passage may be in very many documents, and then gathered by document. Other windows never leave their document.

Input cases: a null or empty text has no words and is never contaminated; a null doc_id is
returned as it is; rows that share a doc_id are judged each on its own; an empty documents or
benchmark table gives empty or clean results; null benchmark texts have no windows, null item ids
are left out; extra columns are ignored by judged() and kept by decontaminate(), whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, fresh, salted_join, written

N = 8
MIN_ITEMS = 2
#: Bytes of a map at most, and for each window up to there.
MAP_BYTES = 1 << 23
BYTES_EACH = 64
#: Windows of a band: 16 bytes each at least.
BAND = MAP_BYTES // 16
#: Size as JSON up to which the benchmark's windows that were met are broadcast, once; larger ones are dealt in copies.
MET_BYTES = 1 << 22
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(k, hash, gram, items): each distinct window of the items, of k words."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("item is not null and size(w) > 0")
    k = F.least(F.size("w"), F.lit(n))
    windows = item.withColumn("k", k).select("item", "k", F.explode(F.expr("transform(sequence(1, size(w) - k + 1), i -> slice(w, i, k))")).alias("gram"))
    return windows.groupBy("k", "gram").agg(F.collect_set("item").alias("items")).select("k", F.xxhash64("gram").alias("hash"), "gram", "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, also: dict[str, Column] | None = None, band: int = BAND) -> DataFrame:
    """A row for each document: rid, doc_id, n_words, columns of also, and the verified hits (at, k, items) gathered."""
    also = also or {}
    grams = written(benchmark_windows(benchmark, n), "grams")
    sizes = grams.groupBy("k").count().collect()  # at most n rows
    many, lengths = sum(x["count"] for x in sizes), sorted(x.k for x in sizes)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"), *(x.alias(c) for c, x in also.items()))
    if not many:
        return base.select("rid", "doc_id", *also, F.size("w").cast("long").alias("n_words"), F.expr("cast(array() as array<struct<at:int,k:int,items:array<string>>>)").alias("hits"))
    bands = -(-many // band)
    if bands > 1:  # the scans of all bands must number rows alike
        base = written(base, "numbered")
    found = None
    for number in range(bands):
        own = grams if bands == 1 else grams.filter(F.pmod(F.xxhash64("hash"), F.lit(bands)) == number)
        rows = looked_up(base, byte_map(own.select("hash")), lengths, list(also), number == 0)
        found = rows if found is None else found.union(rows)
    found = written(found, "hits")  # a row for each document, and one for each hit
    met = written(grams.join(found.filter("gram is not null").select("k", "hash").distinct(), ["k", "hash"], "left_semi"), "met")
    joined = verify(found, met)
    verified = F.when(F.col("items").isNotNull(), F.struct("at", "k", "items"))
    return joined.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in also), F.first("n_words").cast("long").alias("n_words"), F.collect_list(verified).alias("hits"))


def verify(found: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of found with the items of their window, null where it is none. Copies of met never reach the driver."""
    on = ["k", "hash", "gram"]
    size = met.agg(F.sum(F.length(F.to_json(F.struct("gram", "items"))))).first()[0] or 0
    if size <= MET_BYTES:
        return found.join(F.broadcast(met), on, "left")
    return salted_join(found.filter("gram is not null"), met.hint("merge"), on, "rid").unionByName(found.filter("gram is null"), allowMissingColumns=True)


def probes(h: Column, size: int) -> tuple[Column, Column]:
    """The two places of a hash in a map, from 1."""
    return tuple((F.pmod(x, F.lit(size)) + 1).cast("int") for x in (h, F.shiftrightunsigned(h, 31)))


def byte_map(hashes: DataFrame) -> bytes:
    """At most MAP_BYTES bytes with two set for each of at most BAND hashes."""
    size = 1 << 16
    while size < min(MAP_BYTES, BYTES_EACH * hashes.count()):
        size *= 2
    out = bytearray(size)
    for x in hashes.select(F.explode(F.array(*probes(F.col("hash"), size))).alias("place")).distinct().collect():
        out[x.place - 1] = 1
    return bytes(out)


def looked_up(base: DataFrame, held: bytes, lengths: list[int], also: list[str], outer: bool) -> DataFrame:
    """A row for each window that the map holds (at, k, hash, gram); with outer also one, of null gram, for each document
    without any."""

    def there(m: Column, h: Column) -> Column:
        a, b = probes(h, len(held))
        one = F.lit(b"\x01")
        return (F.substring(m, a, F.lit(1)) == one) & (F.substring(m, b, F.lit(1)) == one)

    def some(m: Column, k: int) -> Column:
        starts = F.when(F.size("w") < k, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size("w") - (k - 1)))
        hashed = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.xxhash64(F.slice("w", i, F.lit(k))).alias("hash")))
        return F.filter(hashed, lambda x: there(m, x["hash"]))

    # the map stands in the plan once
    found = F.transform(F.array(F.lit(held)), lambda m: F.concat(*(some(m, k) for k in lengths)))[0]
    rows = base.select("rid", "doc_id", *also, F.size("w").alias("n_words"), "w", (F.explode_outer if outer else F.explode)(found).alias("hit"))
    return rows.select("rid", "doc_id", *also, "n_words", "hit.at", "hit.k", "hit.hash", F.expr("slice(w, hit.at, hit.k)").alias("gram"))


def judged(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_words (1-based), and columns of also."""
    found = hits(docs, benchmark, n, also=also)
    covered = F.expr("array_sort(array_distinct(flatten(transform(hits, h -> sequence(h.at, h.at + h.k - 1)))))")
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select("doc_id", *(also or {}), "n_words", covered.alias("hit_words"), items.alias("items"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        "items",
        "hit_words",
        *(also or {}),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = MIN_ITEMS, cut: bool = True) -> DataFrame:
    """The documents without those that hold windows of min_items benchmark items or more; with cut, the others lose
    the words that any window covers, each with the separator after it. Rows that share a doc_id, or have none, are treated each by its own text."""
    key, own, bad, hit, word, gap = fresh(docs, "key", "own", "bad", "hit", "word", "gap")
    found = judged(docs, benchmark, n, min_items, {"digest": digest()}).filter("n_hit > 0")
    spans = found.groupBy(F.col("doc_id").alias(key), F.col("digest").alias(f"{own}2")).agg(F.max("contaminated").alias(bad), F.first("hit_words").alias(hit))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(f"{own}2"))
    joined = docs.withColumn(own, digest()).join(spans, same, "left").filter(F.col(bad).isNull() | ~F.col(bad))
    if not cut:
        return joined.select(docs.columns)
    parts = joined.withColumns({word: F.when(F.col(hit).isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"))), gap: F.when(F.col(hit).isNotNull(), F.split("text", WORD, -1))})
    kept = F.concat(F.col(gap)[0], F.array_join(F.transform(word, lambda x, i: F.when(F.array_contains(hit, i + 1), "").otherwise(F.concat(x, F.get(F.col(gap), i + 1)))), ""))
    text = F.when(F.col(hit).isNull(), F.col("text")).otherwise(kept)
    return parts.withColumn("text", text).select(docs.columns)
