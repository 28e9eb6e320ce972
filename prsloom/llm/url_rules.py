"""URL filtering by association rules.

Native: DataFrame functions and Spark's own FP-growth. Labelled URLs are turned into sets of
tokens (host labels with their distance from the right, path segments, file endings, query keys, shapes
of segments); FP-growth over tokens and the label gives rules tokens -> label. Rules are kept
above a support and a confidence, and only if no rule of some of their tokens and the same label is as sure. All that are left
stay, a table in the shared folder. They are matched through an inverted index:
each rule is posted under one of its tokens, the rarest, URLs meet only rules posted under their
own tokens, and the rest of the rule is verified. Whether the index is broadcast is decided by its size on disk; URLs
of a common token are dealt over several tasks where it is not.

An explicit list of (host, path, verdict) comes before the method: the longest entry that fits wins.

Input cases: a null url, or one without "://", has an empty host and path, no tokens and the default
verdict; a null page_id stays null; repeated rows each get the same verdict; an empty table, or no
labelled row, gives no mined rules; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host(url).alias("host"), path(url).alias("path"))


def listed(rules=LISTED) -> tuple[Column, Column]:
    """The rule that fits (host/path), and its verdict, of columns host and path; null where none fits."""
    best = []
    for h, p, verdict in rules:
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        best.append((len(h) + len(p), f"{h}{p}", verdict, fits))
    rule = told = F.lit(None).cast("string")
    for _, name, verdict, fits in sorted(best, key=lambda x: x[0]):
        rule, told = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(told)
    return rule, told


TOKENS = r"""array_distinct(filter(concat(
    transform(sequence(1, greatest(size(labels), 1)), i -> if(i <= size(labels), concat('host', i, '=', element_at(labels, -i)), null)),
    flatten(transform(filter(labels, x -> contains(x, '-')), x -> transform(split(x, '-'), y -> concat('part=', y)))),
    transform(segments, x -> if(x rlike '^[0-9]+([.][a-z]+)?$', concat('dir=#', regexp_extract(x, '([.][a-z]+)?$', 0)), concat('dir=', lower(x)))),
    transform(keys, x -> concat('key=', x)),
    array(if(host rlike '[0-9]', 'host has digits', null), if(size(labels) > 3, 'deep host', null))
), x -> x is not null))"""


def tokens(rows: DataFrame) -> DataFrame:
    """rows with a column tokens, from host, path and url."""
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    parts = rows.withColumn("labels", F.array_remove(F.split("host", r"\."), "")).withColumn("segments", F.array_remove(F.split("path", "/"), ""))
    parts = parts.withColumn("keys", F.array_remove(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), ""))
    return parts.withColumn("tokens", F.expr(TOKENS)).drop("labels", "segments", "keys")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All rules (rule_id, antecedent, label, confidence, support) of rows with tokens and a label (block or allow) that no
    rule of a part of their tokens makes needless."""
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = found.filter((F.size("consequent") == 1) & F.col("consequent")[0].startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 7)").alias("label"), "confidence", "support")
    rules = written(rules.select(F.xxhash64("antecedent", "label").alias("rule_id"), "*"), "rules")
    shorter = indexed(rules).select("token", F.col("antecedent").alias("part"), F.col("mined").alias("label"), F.col("confidence").alias("sure"))
    met = rules.withColumn("token", F.explode("antecedent")).join(shorter, ["token", "label"])
    needless = met.filter((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)).select("rule_id").distinct()
    return written(rules.join(needless, "rule_id", "left_anti"), "kept-rules")


def indexed(rules: DataFrame) -> DataFrame:
    """The inverted index: every rule under the token that the fewest rules have."""
    posted = rules.select(F.explode("antecedent").alias("token"), "rule_id", "antecedent", "label", "confidence", "support")
    rare = posted.groupBy("token").agg(F.count("*").alias("n"))
    return posted.join(rare, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("antecedent").alias("antecedent"), F.first("label").alias("mined"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with rid and tokens) and the surest rule whose tokens each has: mined, mined_rule; null without one."""
    columns = [x for x in rows.columns if x != "rid"]
    met = salted_join(rows.withColumn("token", F.explode_outer("tokens")), written(indexed(rules), "index"), ["token"], "rid")
    holds = F.col("rule_id").isNotNull() & (F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.when(holds, F.struct((-F.col("confidence")).alias("c"), (-F.size("antecedent")).alias("n"), (-F.col("support")).alias("s"), "antecedent", "mined"))
    best = met.groupBy("rid").agg(*(F.first(x).alias(x) for x in columns), F.min(rank).alias("best"))
    return best.select("rid", *columns, F.col("best.mined").alias("mined"), F.col("best.antecedent").alias("mined_rule"))


def judge(pages: DataFrame, rules=LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule. The listed rules label the URLs that they fit; rules
    mined from those labels judge all others."""
    rule, told = listed(rules)
    rows = tokens(parsed(pages)).withColumn("rule", rule).withColumn("label", told)
    mined = mine(rows.filter("label is not null").select("tokens", "label"), min_support, min_confidence)
    out = match(rows.withColumn("rid", F.monotonically_increasing_id()), mined)
    ruled = F.when(F.col("label").isNull(), F.concat_ws(" & ", "mined_rule"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "mined", F.lit(default)).alias("verdict"), ruled.alias("mined_rule"))
