"""Document fingerprints of closed syncmers.

Native: DataFrame functions only. A text is read as symbols: a symbol ends with white space, an `e`, or a character
beyond Latin, and has 16 characters at most (about three on average). A k-mer of K symbols is an anchor if the least
of its symbols' hashes stands at its first or last place. That depends on the k-mer alone, so an edit
changes only the anchors that it touches and pieces of a text keep theirs at shifted positions. That is used
here: the anchors of a text whose end is replaced are those of the symbols that stay, and those of the new end read from
the last symbol's start; no anchor of what stays is computed again. A fingerprint holds every anchor in order: base64 of
9 bytes each, the hash and the distance in symbols from the anchor before (the first: from the start; at most K, as one of
any K k-mers in a row is an anchor). The likeness of two is exact, over all their anchors: the first place of
an anchor in one text meets its first place in the other, the second the second, and so on; the places that meet, by all
places of both. A shift costs nothing, and no common shift is asked for. A text of fewer than K symbols has itself
as its only anchor; an empty text has none, and two empty ones are alike 1.

Plan: texts are shuffled twice, by id and to their predecessor's id, where both likenesses are found (the anchors of a
text are longer than the text). The order of the ids is found on ids alone, by a range partitioning and a window in
each range, never in one task.

Input cases: a null text is empty; a null doc_id counts as the smallest id and is returned as null;
rows that share a doc_id follow each other by length, then by a hash of the text; copies of id and text are one document,
returned once, or as often as they stand there if the id is null; a single document
follows itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, shuffle_width, written

K = 4
#: What a document is known by: id, length and a hash of the text.
ROW = ["key", "n", "mark"]
SYMBOL = r"'(?s)[^\\se\\u0250-\\uFFFF]{0,15}.'"


def hashes(text: str) -> str:
    """SQL for the hashes of the symbols of a text."""
    return f"transform(regexp_extract_all({text}, {SYMBOL}, 0), x -> xxhash64(x))"


def anchors(h: str) -> str:
    """SQL for structs (at, hash) of the anchors of a column of symbol hashes; at counts from 0."""
    ends, inner = f"least({h}[i], {h}[i + {K - 1}])", ", ".join(f"{h}[i + {k}]" for k in range(1, K - 1))
    whole = ", ".join(f"{h}[i + {k}]" for k in range(K))
    return f"if(size({h}) < {K}, array(), transform(filter(sequence(0, size({h}) - {K}), i -> {ends} <= least({inner})), i -> struct(i as at, xxhash64({whole}) as hash)))"


def meeting(a: str, b: str) -> str:
    """SQL for how many places of two columns of anchor hashes meet. Time n log n."""
    # sorted hashes, the lowest bit for the side; `cut` has the start of each run, and the end
    sides = f"sort_array(concat(transform({a}, x -> x & -2L), transform({b}, x -> x | 1L)))"
    cuts = "filter(sequence(0, size(s)), i -> i = 0 or i = size(s) or s[i] != s[i - 1])"
    meet = "aggregate(sequence(1, size(y.cut) - 1), 0L, (n, j) -> n + if(j + 1 < size(y.cut) and y.s[y.cut[j - 1]] + 1 = y.s[y.cut[j]] and y.s[y.cut[j - 1]] & 1 = 0, least(y.cut[j] - y.cut[j - 1], y.cut[j + 1] - y.cut[j]), 0))"
    return f"if(size({a}) = 0 or size({b}) = 0, 0L, transform(transform(array({sides}), s -> struct(s, {cuts} as cut)), y -> {meet})[0])"


def likeness(a: str, b: str, n: str) -> str:
    """SQL for n, the places that meet, by all places of both."""
    return f"if(size({a}) = 0 and size({b}) = 0, 1D, {n} / cast(size({a}) + size({b}) - {n} as double))"


def encoded(a: str) -> Column:
    """All anchors (at, hash), in order."""
    return F.expr(f"replace(base64(unhex(array_join(transform({a}, (x, i) -> concat(lpad(hex(x.hash), 16, '0'), lpad(hex(x.at - if(i = 0, 0, {a}[i - 1].at)), 2, '0'))), ''))), '\\r\\n', '')")


def chained(docs: DataFrame) -> DataFrame:
    """(key, n, mark, copies, before): each document's predecessor in ascending order; the first one's is the last."""
    spark = docs.sparkSession
    ranged = written(docs.groupBy(*ROW).agg(F.count("*").alias("copies")).repartitionByRange(shuffle_width(spark), *ROW).withColumn("part", F.spark_partition_id()), "order")
    ends = ranged.groupBy("part").agg(F.max(F.struct(*ROW)).alias("last"))
    whole = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", F.coalesce(F.lag("last").over(whole), F.last("last").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("earlier"))
    within = Window.partitionBy("part").orderBy(*ROW)
    rows = ranged.withColumn("before", F.lag(F.struct(*ROW)).over(within)).join(F.broadcast(ends), "part")
    return rows.select(*ROW, "copies", F.coalesce("before", "earlier").alias("before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter replaced by as much of the next document's start.
    """
    rows = keyed(docs).select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.char_length("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    texts = rows.groupBy(*ROW).agg(F.min("text").alias("text"))
    placed = texts.join(chained(rows), ROW)
    given = placed.select("before.*", F.col("text").alias("next"))
    edited = placed.join(given, ROW).withColumns({"kept": F.expr("left(text, n - n div 4)"), "head": F.expr("left(next, n div 4)")})
    edited = edited.withColumns({"h": F.expr(hashes("text")), "g": F.expr(hashes("next")), "stay": F.expr(f"regexp_extract_all(kept, {SYMBOL}, 0)")})
    # all symbols of what is kept are the text's own, but for the last, which goes on in what comes in
    edited = edited.withColumns({"whole": F.expr("concat(kept, head)"), "m": F.expr("greatest(size(stay) - 1, 0)"), "end": F.expr("concat(if(size(stay) = 0, '', element_at(stay, -1)), head)")}).drop("stay", "kept", "head")
    edited = edited.withColumns({"a": F.expr(anchors("h")), "new": F.expr(f"concat(slice(h, greatest(m - {K - 2}, 1), least(m, {K - 1})), {hashes('end')})")})
    edited = edited.withColumns({"b": F.expr(anchors("new")), "few": F.expr(f"m + size(new) - least(m, {K - 1}) < {K}")})
    alone = lambda t: f"if({t} = '', array(), array(struct(0 as at, xxhash64({t}) as hash)))"
    own, following = (f"if(size({h}) < {K}, {alone(t)}, {x})" for h, t, x in (("h", "text", "a"), ("g", "next", anchors("g"))))
    moved = f"transform(b, x -> struct(x.at + m - least(m, {K - 1}) as at, x.hash as hash))"
    edited = edited.withColumn("same", F.expr(f"if(few, 0, size(filter(a, x -> x.at <= m - {K})))"))
    new = f"if(few, {alone('whole')}, concat(slice(a, 1, same), {moved}))"
    found = edited.select("key", "copies", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("whole").cast("binary"), 256).alias("edited_sha256"), "same", F.expr(own).alias("f"), F.expr(new).alias("e"), F.expr(f"transform({following}, x -> x.hash)").alias("next"))
    # the anchors that stay meet themselves, whatever comes after them
    rest = [f"slice({x}.hash, same + 1, size({x}))" for x in "fe"]
    found = found.withColumns({"ne": F.expr(f"same + {meeting(*rest)}"), "nn": F.expr(meeting("f.hash", "next"))})
    out = found.select(
        F.expr(f"sequence(1L, if(key = {NULL_ID + 1}L - 1L, copies, 1L))").alias("copy"),
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        encoded("f").alias("fingerprint"),
        encoded("e").alias("edited_fingerprint"),
        F.expr(likeness("f", "e", "ne")).alias("near_edited"),
        F.expr(likeness("f", "next", "nn")).alias("near_next"),
    )
    return out.withColumn("copy", F.explode("copy")).drop("copy")
