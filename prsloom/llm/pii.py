"""Personal data by weak supervision.

Native: DataFrame functions only.

Candidates are the base patterns' matches (checked or failing their check) and those of wider
patterns (numbers written like phone numbers, credentials, spelled-out addresses). Three labelers
vote on every candidate, 1 (personal), 0 (not) or abstain: `regex` by the strict form and check of
the kind, `gazetteer` by listed top-level domains, card prefixes, reserved address blocks and credential
words, `context` by cue words around the span. Votes form patterns: with the kind and two length
classes there are at most a few hundred, so their counts are what the driver holds, whatever the
corpus. Expectation-maximisation over the counts estimates how reliable each labeler is and how
likely each pattern is personal; a logistic span classifier is fitted to those likelihoods over
votes, kind and length, and decides every candidate. Base matches that pass their check always stay.

Positions are in code points, end exclusive: a text is split at the matches, and the running
lengths of what lies between them and of the matches are window sums within the document, so that
a text with very many matches costs no more than sorting them.

Input cases: a null or empty text has no spans; a null doc_id is returned as it is; rows that share a
doc_id are judged each on its own, in redact() too; an
empty table gives an empty result; extra columns are ignored, or kept by redact(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, fresh, written

BASE_KINDS = ("email", "ip", "card", "phone")
#: Java forms of the base patterns. Possessive loops match what the plain ones do, without recursion;
#: an email starts where its run of characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\x22?[A-Za-z0-9+/_-]{8,}+\x22?",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{2,63}+\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z]{2,12}",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "instr(text, '@') > 0", "spelled": "text rlike '(?i)[(\\\\[]at[)\\\\]]'", "secret": "text rlike '[=:]'", "phone": "instr(text, '+') > 0", "ip": "text rlike '[0-9]\\\\.[0-9]'"}
KINDS = tuple(PATTERNS)
CUES = r"(?i)(?:e-?mail|contact|write|mail|tel|phone|call|fax|mobile|card|visa|credit|account|ip|host|server|address|login|user|password|token|secret|key)[^A-Za-z]{0,4}$"
AGAINST = r"(?i)(?:version|isbn|issn|doi|order|invoice|build|rev|id|no|nr|page|chapter|section|v)[^A-Za-z]{0,3}$"
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "us", "ca", "mx", "ar")
ABSTAIN = -1


def q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, F.try_to_number(x, F.lit("9")).cast("int")).otherwise(F.try_to_number(x, F.lit("9")).cast("int") * 2)),
        F.lit(0),
        lambda s, x: s + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0))),
    )
    return total % 10 == 0


def small(part: Column) -> Column:
    """A run of digits is at most 255."""
    bare = F.regexp_replace(part, r"^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0") <= "255")


def candidates(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document and candidate: rid, doc_id, columns of also, kind, start, end, match, before; kind is null in the
    one row of a document without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(x.alias(c) for c, x in (also or {}).items()))
    wanted = " or ".join(sorted({NEEDS.get(kind, "text rlike '[0-9]'") for kind in KINDS}))
    lists = []
    for k, kind in enumerate(KINDS):
        need = NEEDS.get(kind, "text rlike '[0-9]'")
        # (text before the match, match), in order; what follows the last match has no match
        lists.append(f"if({need}, transform(regexp_extract_all(text, {q(PATTERNS[kind])}, 0), (m, i) -> struct({k} as kind, i as place, m as match)), array())")
    gaps = [f"if({NEEDS.get(kind, 'text rlike ' + q('[0-9]'))}, split(text, {q(PATTERNS[kind])}, -1), array())" for kind in KINDS]
    zipped = ", ".join(f"transform({a}, (x, i) -> struct(x.kind as kind, x.place as place, x.match as match, char_length(gap[{k}][i]) as gap, right(gap[{k}][i], 32) as before))" for k, a in enumerate(lists))
    found = rows.withColumn("gap", F.expr(f"if({wanted}, array({', '.join(gaps)}), null)"))
    found = found.select("rid", "doc_id", *(also or {}), F.explode_outer(F.expr(f"if({wanted}, concat({zipped}), null)")).alias("c")).select("rid", "doc_id", *(also or {}), "c.*")
    up_to = Window.partitionBy("rid", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.char_length("match")).over(up_to)
    return found.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.char_length("match")).cast("int")).drop("gap", "place")


def voted(found: DataFrame) -> DataFrame:
    """Candidates with the base check and the labelers' votes."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    found = found.withColumn("kind", kind)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    parts = F.split("match", r"\.")
    is_ip = small(parts[0]) & small(F.get(parts, F.lit(1))) & small(F.get(parts, F.lit(2))) & small(F.get(parts, F.lit(3)))
    base = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", is_ip).when(F.col("kind") == "card", n.between(13, 19) & luhn(F.when(n <= 19, digits).otherwise(""))).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(False)
    found = found.withColumn("base", base).withColumn("n", n)
    strict = F.when(F.col("base"), 1).when(F.col("kind").isin("number", "secret", "spelled"), ABSTAIN).otherwise(0)
    last = F.lower(F.regexp_extract("match", r"([A-Za-z]+)\W*$", 1))
    listed = (
        F.when(F.col("kind").isin("email", "spelled"), F.when(last.isin(*TOP_LEVEL), 1).otherwise(0))
        .when(F.col("kind") == "ip", F.when(F.col("match").rlike(r"^(?:0|127|255)\."), 0).when(is_ip, 1).otherwise(ABSTAIN))
        .when(F.col("kind") == "card", F.when(F.col("base") & F.col("match").rlike("^[3-6]"), 1).when(n.between(13, 19), ABSTAIN).otherwise(0))
        .when(F.col("kind") == "phone", F.when(F.col("match").rlike(r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6|7|8|9)"), 1).otherwise(ABSTAIN))
        .when(F.col("kind") == "secret", F.when(F.col("match").rlike(r"[0-9]") & F.col("match").rlike(r"[=:]\x20?\x22?[A-Za-z0-9+/_-]*[A-Fa-f]"), 1).otherwise(ABSTAIN))
        .otherwise(ABSTAIN)
    )
    context = F.when(F.col("before").rlike(CUES), 1).when(F.col("before").rlike(AGAINST), 0).when(F.col("kind") == "secret", 1).otherwise(ABSTAIN)
    long = F.when(F.char_length("match") >= 10, 1).otherwise(0)
    return found.withColumns({"regex": strict, "gazetteer": listed, "context": context, "long": long})


LABELERS = ("regex", "gazetteer", "context")


def fit(patterns: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 50) -> dict[str, float]:
    """EM over counted vote patterns (kind, votes, long, count), then the span classifier's weights.

    The labelers are taken as independent given whether the span is personal; each has a rate of
    voting 1 for personal and for other spans. Starts from a majority vote and priors that a
    labeler is right more often than not, which also fixes which class is which.
    """
    if not patterns:
        return {}

    def sigmoid(x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    likely = []
    for _, votes, _, _ in patterns:
        cast = [v for v in votes if v != ABSTAIN]
        likely.append(0.5 if not cast else (sum(cast) + 0.5) / (len(cast) + 1))
    rates = []
    for _ in range(rounds):
        total = sum(x[3] for x in patterns)
        prior = (sum(p * x[3] for p, x in zip(likely, patterns, strict=True)) + 1) / (total + 2)
        rates = []
        for k in range(len(LABELERS)):
            yes, all_yes, no, all_no = 8.0, 10.0, 2.0, 10.0
            for p, (_, votes, _, count) in zip(likely, patterns, strict=True):
                if votes[k] != ABSTAIN:
                    yes, all_yes, no, all_no = yes + p * count * votes[k], all_yes + p * count, no + (1 - p) * count * votes[k], all_no + (1 - p) * count
            rates.append((yes / all_yes, no / all_no))
        for at, (_, votes, _, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior))
            for (a, b), v in zip(rates, votes, strict=True):
                if v != ABSTAIN:
                    odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            likely[at] = sigmoid(odds)
    weights: dict[str, float] = {}
    features = [["bias", f"kind={kind}", f"long={long}", *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True))] for kind, votes, long, _ in patterns]
    scale = [min(1.0, 0.2 + x[3] / 50) for x in patterns]  # rare patterns count, common ones do not drown them
    for _ in range(400):
        step: dict[str, float] = {}
        for names, p, s in zip(features, likely, scale, strict=True):
            error = s * (p - sigmoid(sum(weights.get(x, 0.0) for x in names)))
            for x in names:
                step[x] = step.get(x, 0.0) + error
        for x, d in step.items():
            weights[x] = weights.get(x, 0.0) + 1.0 * (d - 0.02 * weights.get(x, 0.0)) / max(1.0, math.sqrt(len(patterns)))
    return weights


def classified(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each candidate of each document with base, score and found; one with a null kind where there is none."""
    table = written(voted(candidates(docs, also)).select("rid", "doc_id", *(also or {}), "kind", "start", "end", "base", *LABELERS, "long"), "spans")
    counted = table.filter("kind is not null").groupBy("kind", *LABELERS, "long").agg(F.count("*").alias("n")).collect()  # a few hundred rows at most
    weights = fit(sorted((x.kind, tuple(x[y] for y in LABELERS), x.long, x.n) for x in counted))
    score = F.lit(weights.get("bias", 0.0))
    for column in ("kind", "long", *LABELERS):
        told = F.lit(0.0)
        for name, w in weights.items():
            if name.startswith(f"{column}="):
                told = F.when(F.col(column).cast("string") == name.partition("=")[2], F.lit(w)).otherwise(told)
        score = score + told
    score = 1 / (1 + F.exp(-score))
    return table.withColumn("score", score).withColumn("found", F.col("kind").isNotNull() & (F.col("base") | (F.col("score") >= 0.5)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of each document."""
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    order = sum((F.when(F.col("kind") == kind, k).otherwise(0) for k, kind in enumerate(KINDS)), F.lit(0))
    entry = F.struct(order.alias("o"), "start", name.alias("name"))
    out = classified(docs).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.array_sort(F.collect_list(F.when(F.col("base"), entry))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("found"), entry))).alias("s"),
    )
    listed = lambda x: F.array_join(F.transform(x, lambda y: y["name"]), ",")
    return out.select("doc_id", *(f"n_{kind}" for kind in BASE_KINDS), F.sha2(listed("b"), 256).alias("base_sha256"), listed("s").alias("spans"), F.size("s").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlapping spans become one."""
    key, own, other, spans = fresh(docs, "key", "own", "other", "spans")
    found = classified(docs, {"digest": digest()}).filter("found").select("doc_id", "digest", "start", "end", "kind").distinct()
    before = Window.partitionBy("doc_id", "digest").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    opens = found.withColumn("opens", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    groups = opens.withColumn("g", F.sum("opens").over(Window.partitionBy("doc_id", "digest").orderBy("start", F.desc("end"), "kind")))
    merged = groups.groupBy("doc_id", "digest", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    listed = merged.groupBy(F.col("doc_id").alias(key), F.col("digest").alias(other)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(spans))
    cut = F.expr(f"""concat(
        array_join(transform(`{spans}`, (s, i) -> concat(substring(text, if(i = 0, 0, `{spans}`[i - 1].end) + 1, s.start - if(i = 0, 0, `{spans}`[i - 1].end)), '<', upper(s.kind), '>')), ''),
        substring(text, element_at(`{spans}`, -1).end + 1))""")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(other))
    joined = docs.withColumn(own, digest()).join(listed, same, "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).select(docs.columns)
