"""Named queries over the fixture views, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsloom.functions import columns as C
from prsloom.operators import finemap, harmonize, ld, ldsc, models, qc, score
from prsloom.plans.fixtures import oracle, view
from prsloom.tables import written

QUERIES: dict = {}
ORACLES: dict = {}
BLOCK = 16


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, more)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def geno(spark, d) -> DataFrame:
    return score.packed(view(spark, d, "geno"))


def weights(spark, d) -> DataFrame:
    return view(spark, d, "weights")


# --- genotypes and scores -------------------------------------------------------------------------

STATS = "stats as (select g.v, count(*) n, count(g.g) n_called, coalesce(avg(cast(g.g as double)), 0.0) m, sqrt(sum((coalesce(g.g, t.m) - t.m) * (coalesce(g.g, t.m) - t.m)) / count(*)) sd from geno g join (select v, coalesce(avg(cast(g as double)), 0.0) m from geno group by v) t on t.v = g.v group by g.v)"
STD = STATS + ", z as (select g.s, g.v, case when t.sd > 1e-12 then (coalesce(cast(g.g as double), t.m) - t.m) / t.sd else 0.0 end z from geno g join stats t on t.v = g.v)"


@query("select v vidx, round(coalesce(avg(cast(g as double)) / 2, 0.0), 6) + 0.0 af from geno group by v")
def allele_frequency(spark, d):
    return score.dosage_stats(geno(spark, d)).select("vidx", r6("af").alias("af"))


@query("select v vidx, cast(n as bigint) n, cast(n_called as bigint) n_called, round(m, 6) + 0.0 mean, round(sd, 6) + 0.0 sd from stats", STATS)
def dosage_stats(spark, d):
    return score.dosage_stats(geno(spark, d)).select("vidx", "n", "n_called", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("select s sidx, v vidx, round(z, 6) + 0.0 z from z", STD)
def standardize_dosage(spark, d):
    # samples are numbered 0.. in the fixture, as places in the array are
    return score.standardized(geno(spark, d)).select("vidx", F.posexplode("z").alias("sidx", "z")).select(F.col("sidx").cast("long").alias("sidx"), "vidx", r6("z").alias("z"))


@query("select z.s sidx, round(sum(w.weight * z.z), 5) + 0.0 score from z join weights w on w.vidx = z.v group by z.s", STD)
def prs_standardized(spark, d):
    return score.scores(geno(spark, d), weights(spark, d)).select("sidx", (F.round("score", 5) + 0.0).alias("score"))


@query("select g.s sidx, round(sum(w.weight * coalesce(cast(g.g as double), t.m)), 5) + 0.0 score from geno g join stats t on t.v = g.v join weights w on w.vidx = g.v group by g.s", STATS)
def prs_raw(spark, d):
    return score.scores(geno(spark, d), weights(spark, d), standardize=False).select("sidx", (F.round("score", 5) + 0.0).alias("score"))


@query("select g.s sidx, round(sum(case when sqrt(2 * e.af * (1 - e.af)) > 1e-12 then w.weight * (coalesce(cast(g.g as double), 2 * e.af) - 2 * e.af) / sqrt(2 * e.af * (1 - e.af)) else 0.0 end), 5) + 0.0 score from geno g join effects e on e.vidx = g.v join weights w on w.vidx = g.v group by g.s")
def prs_frozen(spark, d):
    e = view(spark, d, "effects").select("vidx", C.frozen_mean(F.col("af"), F.lit(False)).alias("mean"), F.sqrt(2 * F.col("af") * (1 - F.col("af"))).alias("sd"))
    return score.scores(geno(spark, d), weights(spark, d).join(e, "vidx"), frozen=True).select("sidx", (F.round("score", 5) + 0.0).alias("score"))


SCORED = STATS + ", raw as (select g.s sidx, round(sum(w.weight * coalesce(cast(g.g as double), t.m)), 5) + 0.0 score from geno g join stats t on t.v = g.v join weights w on w.vidx = g.v group by g.s)"


@query("select sidx, score, round((score - avg(score) over ()) / stddev_pop(score) over (), 6) + 0.0 z, round((rank() over (order by score) - 1 + (count(*) over (partition by score) - 1) / 2.0 + 0.5) / count(*) over (), 6) + 0.0 pct from raw", SCORED)
def prs_percentile(spark, d):
    return score.ranked(prs_raw(spark, d)).select("sidx", "score", r6("z").alias("z"), r6("pct").alias("pct"))


@query("select round(corr(a.score, p.y) * corr(a.score, p.y), 6) + 0.0 r2 from raw a join pheno p on p.s = a.sidx", SCORED)
def prediction_r2(spark, d):
    pairs = prs_raw(spark, d).join(view(spark, d, "pheno"), F.col("sidx") == F.col("s"))
    return score.prediction_r2(pairs, "score", "y").select(r6("r2").alias("r2"))


@query("select v vidx, s sidx, case when v % 2 = 1 then 2.0 - g else cast(g as double) end g from geno")
def dosage_recode(spark, d):
    rows = geno(spark, d).select("vidx", C.recoded(F.col("dosage"), F.col("vidx") % 2 == 1).alias("g"))
    return rows.select("vidx", F.posexplode("g").alias("sidx", "g")).select("vidx", F.col("sidx").cast("long").alias("sidx"), "g")


# --- scalar functions ------------------------------------------------------------------------------


@query("select row_no, case when info > 0.6 then round(ln(0.5 + eaf), 6) + 0.0 end beta from sumstats_big")
def or_to_beta(spark, d):
    odds = F.when(F.col("info") > 0.6, 0.5 + F.col("eaf")).otherwise(-1.0)
    return view(spark, d, "sumstats_big").select("row_no", r6(C.or_to_beta(odds)).alias("beta"))


@query(f"select row_no, round(case when eaf > 0 and eaf < 1 and beta != 0 then abs(beta) / -({C.normal_quantile_sql('(eaf / 2)')}) end, 6) + 0.0 se from sumstats_big")
def se_from_p(spark, d):
    return view(spark, d, "sumstats_big").select("row_no", r6(C.se_from_p(F.col("beta"), F.col("eaf"))).alias("se"))


@query("select row_no, round(case when n_eff * se * se + beta * beta > 0 then beta / sqrt(n_eff * se * se + beta * beta) else 0.0 end, 6) + 0.0 beta_std, round(beta / se, 6) + 0.0 z from sumstats_big where se is not null")
def standardize_betas(spark, d):
    s = view(spark, d, "sumstats_big").filter("se is not null")
    return s.select("row_no", r6(C.standardize_beta(F.col("beta"), F.col("se"), F.col("n_eff"))).alias("beta_std"), r6(F.when(F.col("se") > 0, F.col("beta") / F.col("se"))).alias("z"))


NORM = "case upper(regexp_replace(trim({c}), '^(chr|CHR|Chr)', '')) when '23' then 'X' when '24' then 'Y' when '25' then 'XY' when '26' then 'MT' when 'M' then 'MT' else upper(regexp_replace(trim({c}), '^(chr|CHR|Chr)', '')) end"


@query(f"select distinct c chrom, {NORM.format(c='c')} norm from (select concat(case l_linenumber % 3 when 0 then 'chr' when 1 then ' CHR' else '' end, case when l_suppkey % 28 = 27 then 'm' else cast(l_suppkey % 28 as string) end) c from lineitem) t")
def norm_chrom(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    n = F.when(F.col("l_suppkey") % 28 == 27, "m").otherwise((F.col("l_suppkey") % 28).cast("string"))
    c = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "chr").when(F.col("l_linenumber") % 3 == 1, " CHR").otherwise(""), n)
    return li.select(c.alias("chrom")).distinct().select("chrom", C.norm_chrom(F.col("chrom")).alias("norm"))


@query("select row_no, case when regexp_full_match(concat(ea, oa, ea), '[ACGT]*') then reverse(translate(concat(ea, oa, ea), 'ACGT', 'TGCA')) end rc, (concat(ea, oa) in ('AT', 'TA', 'CG', 'GC')) pal from sumstats_big")
def complement_alleles(spark, d):
    s = view(spark, d, "sumstats_big")
    return s.select("row_no", C.complement(F.concat("ea", "oa", "ea")).alias("rc"), C.palindromic(F.col("ea"), F.col("oa")).alias("pal"))


@query("select row_no, round(case when eaf > 0 and eaf < 1 then power(2 * eaf * (1 - eaf), 0.75) / (select avg(power(2 * eaf * (1 - eaf), 0.75)) from sumstats_big where eaf > 0 and eaf < 1) else 1.0 end, 6) + 0.0 w from sumstats_big")
def maf_slab_weights(spark, d):
    s = view(spark, d, "sumstats_big").withColumn("w", C.slab_weight(F.col("eaf"), -0.25))
    return s.crossJoin(F.broadcast(s.agg(F.avg("w").alias("m")))).select("row_no", r6(F.coalesce(F.col("w") / F.col("m"), F.lit(1.0))).alias("w"))


@query("select c_custkey k, round(case when c_custkey % 7 > 0 then 4.0 / (1.0 / (c_custkey % 7 * 100) + 1.0 / (c_custkey + 10)) end, 6) + 0.0 n_eff from customer")
def n_eff_case_control(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("k"), r6(C.n_eff_case_control((F.col("c_custkey") % 7 * 100).cast("double"), (F.col("c_custkey") + 10).cast("double"))).alias("n_eff"))


@query("select vidx, round(beta * beta * power(0.05 * 0.95, 2) / (power(0.10313564037537152, 2) * 0.3 * 0.7), 8) + 0.0 h2_liability from effects")
def h2_liability(spark, d):
    return view(spark, d, "effects").select("vidx", (F.round(F.col("beta") * F.col("beta") * C.liability_factor(0.05, 0.3), 8) + 0.0).alias("h2_liability"))


# --- quality control --------------------------------------------------------------------------------

FLAGS = """flags as (select s.row_no, case when s.beta is null or s.se is null or s.se <= 0 then 'nonfinite' when c.n > 1 then 'duplicate' when s.n_eff < 0.7 * (select max(n_eff) from {t}) then 'low_n'
    when least(s.eaf, 1 - s.eaf) < 0.01 then 'low_maf' when s.info < 0.7 then 'low_info' when (s.beta / s.se) * (s.beta / s.se) > 30 then 'high_chisq' end reason
    from (select *, {k} k from {t}) s join (select {k} k, count(*) n from {t} group by 1) c on c.k = s.k)"""
KEY = "case when id != '' and id != '.' then concat('i:', id) else concat_ws('|', 'p:', chrom, cast(pos as string), ea, oa) end"


@query("select row_no, reason from flags", FLAGS.format(t="sumstats", k=KEY))
def qc_flags(spark, d):
    return qc.flagged(view(spark, d, "sumstats"), max_chisq=30.0).select("row_no", "reason")


COUNTS = "select count(*) n_in, " + ", ".join(f"count(*) filter (reason = '{r}') n_{r}" for r in qc.REASONS) + ", count(*) filter (reason is null) n_out from flags"


@query(COUNTS, FLAGS.format(t="sumstats", k=KEY))
def qc_counts(spark, d):
    return qc.counts(qc.flagged(view(spark, d, "sumstats"), max_chisq=30.0))


@query(COUNTS, FLAGS.format(t="sumstats_pairs", k=KEY))
def qc_counts_big(spark, d):
    return qc.counts(qc.flagged(view(spark, d, "sumstats_pairs"), max_chisq=30.0))


@query("select row_no, round(sr, 6) + 0.0 sd_ref, round(raw * k / sr, 6) + 0.0 ratio, coalesce(sr >= 0.05 and raw * k / sr between 0.5 and 2.0, false) keep from (select *, quantile_cont(sr / raw, 0.5) over () k from (select row_no, sqrt(2 * eaf * (1 - eaf)) sr, 1 / sqrt(n_eff * se * se + beta * beta) raw from sumstats_big where se is not null and eaf > 0) t) u")
def sd_consistency(spark, d):
    s = view(spark, d, "sumstats_big").filter("se is not null and eaf > 0").withColumnRenamed("eaf", "af_ref")
    return qc.sd_consistent(s).select("row_no", r6("sd_ref").alias("sd_ref"), r6("ratio").alias("ratio"), "keep")


@query("select row_no, round(least(coalesce(raw * 50000.0 / quantile_cont(raw, 0.99) over (), 50000.0), 50000.0), 4) + 0.0 n_imputed from (select row_no, case when se > 0 and 2 * eaf * (1 - eaf) > 0 then 1 / (se * se * 2 * eaf * (1 - eaf)) end raw from sumstats_big) t")
def impute_n_eff(spark, d):
    s = view(spark, d, "sumstats_big").withColumnRenamed("eaf", "af_ref")
    return qc.imputed_n(s, 50000.0).select("row_no", (F.round("n_imputed", 4) + 0.0).alias("n_imputed"))


@query("select v.vidx from variants v where exists (select 1 from regions r where r.chrom = v.chrom and v.pos between r.start_pos and r.end_pos)")
def region_filter(spark, d):
    r = view(spark, d, "regions").withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    return qc.in_regions(view(spark, d, "variants"), r).select("vidx")


# --- matching ---------------------------------------------------------------------------------------

C1 = "reverse(translate({x}, 'ACGT', 'TGCA'))"
HIT = """hits as (select s.*, coalesce(i.vidx, p.vidx) vidx from {s} s
    left join (select id, min(vidx) vidx from {v} where id not in ('', '.') group by id) i on i.id = s.id
    left join (select chrom, pos, min(vidx) vidx from {v} group by chrom, pos) p on p.chrom = replace(s.chrom, 'chr', '') and p.pos = s.pos),
  acted as (select h.*, v.a1, v.a2, case when concat(ea, oa) in ('AT', 'TA', 'CG', 'GC') then 'palindrome'
    when (ea = a1 and oa = a2) then case when beta is not null and se is not null then 'keep' else 'nonfinite' end
    when (ea = a2 and oa = a1) then case when beta is not null and se is not null then 'swap' else 'nonfinite' end
    when (rea = a1 and roa = a2) then case when beta is not null and se is not null then 'strand_keep' else 'strand_nonfinite' end
    when (rea = a2 and roa = a1) then case when beta is not null and se is not null then 'strand_swap' else 'strand_nonfinite' end else 'mismatch' end action
    from (select *, reverse(translate(ea, 'ACGT', 'TGCA')) rea, reverse(translate(oa, 'ACGT', 'TGCA')) roa from hits where vidx is not null) h join {v} v on v.vidx = h.vidx),
  claimed as (select *, min(case when action in ('keep', 'swap', 'strand_keep', 'strand_swap') then row_no end) over (partition by vidx) winner from acted)"""
HARMONIZED = "select vidx, row_no, round(case when action in ('swap', 'strand_swap') then -beta else beta end, 6) + 0.0 beta, se, n_eff, action in ('swap', 'strand_swap') flipped from claimed where row_no = winner"
HLOG = "select count(*) filter (action in ('keep', 'swap', 'strand_keep', 'strand_swap')) n_matched, count(*) filter (action in ('swap', 'strand_swap')) n_flipped, count(*) filter (action like 'strand%') n_strand_flipped, count(*) filter (action = 'palindrome') n_palindrome, count(*) filter (action in ('mismatch', 'nonfinite', 'strand_nonfinite')) n_mismatch from claimed where winner is null or row_no <= winner"


def _harmonized(spark, d, big: bool):
    end = "_big" if big else ""
    return harmonize.aligned(view(spark, d, f"sumstats{end}"), view(spark, d, f"variants{end}"))


def _aligned(rows):
    return harmonize.harmonized(rows).withColumn("beta", r6("beta"))


@query(HARMONIZED, HIT.format(s="sumstats", v="variants"))
def harmonize_match(spark, d):
    return _aligned(_harmonized(spark, d, False))


@query(HARMONIZED, HIT.format(s="sumstats_big", v="variants_big"))
def harmonize_big(spark, d):
    return _aligned(_harmonized(spark, d, True))


@query(HLOG, HIT.format(s="sumstats", v="variants"))
def harmonize_counts(spark, d):
    return harmonize.log(_harmonized(spark, d, False))


@query(HLOG, HIT.format(s="sumstats_big", v="variants_big"))
def harmonize_counts_big(spark, d):
    return harmonize.log(_harmonized(spark, d, True))


@query("select a.n n_id_overlap, b.n n_pos_overlap, a.moved n_moved, a.moved * 2 > a.n build_mismatch from (select count(*) n, count(*) filter (s.pos != v.pos) moved from (select id, min(pos) pos from sumstats_big where id not in ('', '.') group by id) s join (select id, min(pos) pos from variants_big group by id) v on v.id = s.id) a, (select count(*) n from (select distinct replace(chrom, 'chr', '') c, pos from sumstats_big intersect select distinct chrom c, pos from variants_big) t) b")
def diagnose_match(spark, d):
    return harmonize.diagnose(view(spark, d, "sumstats_big"), view(spark, d, "variants_big"))


@query("select v.vidx, v.vidx + 1000 panel_vidx, v.vidx % 3 = 0 recode from variants v where v.vidx % 5 > 0")
def external_panel(spark, d):
    v = view(spark, d, "variants")
    swap = F.col("vidx") % 3 == 0
    panel = v.filter("vidx % 5 > 0").select((F.col("vidx") + 1000).alias("vidx"), "id", F.when(swap, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(swap, F.col("a1")).otherwise(F.col("a2")).alias("a2"))
    return harmonize.on_panel(v, panel)


@query("select v.vidx, coalesce(a.x, 0.0) x from variants_big v left join (select concat('rs', l_partkey) id, max_by(l_tax, l_partkey * 1000000 + l_suppkey) x from (select l_partkey, l_suppkey, max(l_tax) l_tax from lineitem where l_discount >= 0.1 group by 1, 2) group by 1) a on a.id = v.id")
def annotation_align(spark, d):
    # some parts were never sold at the highest discount: variants without an annotation
    li = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_discount >= 0.1").groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("x"))
    rows = li.select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("row_no"), F.concat(F.lit("rs"), "l_partkey").alias("id"), "x")
    return harmonize.with_annotations(view(spark, d, "variants_big"), rows, ["x"]).select("vidx", "x")


@query("select vidx from variants_big where id in (select id from sumstats_big where id not in ('', '.') and info > 0.9)")
def wanted_variants(spark, d):
    return harmonize.wanted(view(spark, d, "variants_big"), view(spark, d, "sumstats_big").filter("info > 0.9")).select("vidx")


# --- linkage disequilibrium ---------------------------------------------------------------------------


def blocks(spark, d, calls=None, **kw) -> DataFrame:
    packed = geno(spark, d) if calls is None else score.packed(calls)
    return ld.compute_blocks(packed, ld.block_bounds(written(view(spark, d, "variants"), "variants"), BLOCK), **kw)


def effects(spark, d, calls=None) -> DataFrame:
    calls = written(view(spark, d, "geno"), "calls") if calls is None else calls
    e = written(view(spark, d, "effects", geno=calls), "effects")
    return e.join(view(spark, d, "weights", effects=e), "vidx").select("vidx", F.col("weight").alias("beta"), F.col("n").alias("n"))


def fitted_on(spark, d) -> tuple[DataFrame, DataFrame]:
    """Blocks and effects from one table of calls."""
    calls = written(view(spark, d, "geno"), "calls")
    return blocks(spark, d, calls), effects(spark, d, calls)


PAIRS = STD + f", pairs as (select a.v // {BLOCK} * {BLOCK} block_id, a.v % {BLOCK} i, b.v % {BLOCK} j, case when a.v = b.v then 1.0 else sum(a.z * b.z) / count(*) end r from z a join z b on a.s = b.s and a.v // {BLOCK} = b.v // {BLOCK} group by a.v, b.v)"
PAIR = "select block_id, cast(i as integer) i, cast(j as integer) j, round({r}, 5) + 0.0 r from pairs"


def r5(p):
    return p.select("block_id", "i", "j", (F.round("r", 5) + 0.0).alias("r"))


@query("select vidx, (vidx - first) // 24 * 24 + first block_id, (vidx - first) % 24 place from (select vidx, vidx // 32 * 32 first from variants) t")
def ld_block_bounds(spark, d):
    return ld.block_bounds(view(spark, d, "variants"), 24)


@query(PAIR.format(r="r"), PAIRS)
def ld_pairs(spark, d):
    return r5(ld.pairs(blocks(spark, d)))


@query(PAIR.format(r="case when i = j then 1.0 else 0.9 * r end"), PAIRS)
def ld_ridge(spark, d):
    return r5(ld.pairs(blocks(spark, d, ridge=0.1)))


@query(PAIR.format(r=f"case when i = j then 1.0 else (1 - {BLOCK} / 200.0) * r end"), PAIRS)
def ld_shrink(spark, d):
    return r5(ld.pairs(ld.shrink_blocks(blocks(spark, d), 200.0)))


@query(PAIR.format(r="r") + " where i = j or (abs(r) >= 0.05 and abs(i - j) <= 6)", PAIRS)
def ld_sparsify(spark, d):
    return r5(ld.pairs(blocks(spark, d, kind="sparse", threshold=0.05, max_dist=6)))


@query("select block_id + i vidx, round(sum(r * r - (1 - r * r) / 498.0), 4) + 0.0 ld_score from pairs group by block_id, i", PAIRS)
def ld_scores(spark, d):
    return ld.ld_scores(blocks(spark, d), n_ref=500).select("vidx", (F.round("ld_score", 4) + 0.0).alias("ld_score"))


@query(f"select p.block_id, cast(c.c as integer) cut, round(sum(p.r * p.r), 5) + 0.0 cost from pairs p join (select unnest(generate_series(1, {BLOCK - 1})) c) c on p.i < c.c and p.j >= c.c group by p.block_id, c.c", PAIRS)
def ld_cut_cost(spark, d):
    return ld.cut_costs(ld.pairs(blocks(spark, d))).select("block_id", "cut", (F.round("cost", 5) + 0.0).alias("cost"))


@query("select p.block_id, round(sum(a.weight * p.r * b.weight), 6) + 0.0 h2 from pairs p join weights a on a.vidx = p.block_id + p.i join weights b on b.vidx = p.block_id + p.j group by p.block_id", PAIRS)
def partition_h2(spark, d):
    return ld.partition_h2(*fitted_on(spark, d)).select("block_id", r6("h2").alias("h2"))


@query("select round(sum(a.weight * p.r * b.weight), 6) + 0.0 h2 from pairs p join weights a on a.vidx = p.block_id + p.i join weights b on b.vidx = p.block_id + p.j", PAIRS)
def genetic_variance(spark, d):
    return ld.partition_h2(*fitted_on(spark, d)).agg(r6(F.sum("h2")).alias("h2"))


@query()
def ld_lowrank(spark, d):
    return ld.pairs(models.low_rank_blocks(blocks(spark, d))).select("block_id", "i", "j", (F.round("r", 4) + 0.0).alias("r"))


# Dynamic programming over cuts in SQL: best[e + 1] is the least cost of the first e variants, source[e + 1] where the last block starts.
CUTS = PAIRS + f""", costs as (select block_id, list(cost order by c) cost from (select p.block_id, c.c, sum(case when p.i < c.c and p.j >= c.c then p.r * p.r else 0.0 end) cost from pairs p, (select unnest(generate_series(1, {BLOCK})) c) c group by p.block_id, c.c) t group by block_id),
  dp as (select block_id, 0 e, [0.0::double] best, [0] source from costs union all
    select block_id, e + 1, list_append(best, coalesce(list_min(tried), 1e300) + case when e + 1 < {BLOCK} then cost[e + 1] else 0.0 end), list_append(source, greatest(0, e + 1 - 8) + coalesce(list_position(tried, list_min(tried)), 1) - 1)
    from (select d.*, c.cost, list_transform(range(greatest(0, e + 1 - 8), e), lambda s: best[s + 1]) tried from dp d join costs c on c.block_id = d.block_id where e < {BLOCK}) t),
  walk as (select block_id, source, {BLOCK} upto, source[{BLOCK} + 1] start from dp where e = {BLOCK} union all select block_id, source, start, source[start + 1] from walk where start > 0)"""


@query("select block_id, block_id + start start, upto - start size from walk", CUTS)
def optimal_blocks(spark, d):
    return ld.optimal_blocks(blocks(spark, d), 8, 2).select("block_id", "start", F.col("size").cast("int").alias("size"))


@query(f"select block_id + start + w.k vidx, block_id + start block_id, cast(w.k as bigint) place from walk, (select unnest(generate_series(0, 7)) k) w where w.k < upto - start", CUTS)
def optimal_split(spark, d):
    """The same cuts without a matrix over a chromosome: runs of 16 variants stand in for chromosomes."""
    runs = view(spark, d, "variants").withColumn("chrom", F.expr(f"cast(vidx div {BLOCK} as string)"))
    return ld.optimal_split(geno(spark, d), runs, 8, 2, window=BLOCK)


# --- moments ------------------------------------------------------------------------------------------

ROWS = "rows as (select vidx, vidx number, n_eff * beta * beta / (n_eff * se * se + beta * beta) chisq, ell, n_eff from (select p_partkey vidx, p_partkey % 40 / 10.0 + 1 ell, 20000.0 + p_partkey % 100 n_eff, ((p_partkey * 37) % 101 - 50) / 1000.0 beta, 0.007 se from part) t)"
FIT = """f{k} as (select (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw a from
    (select sum(w) sw, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy from (select x, y, 1 / (2.0 * mu * mu) / greatest(ell, 1.0) w from (select x, y, ell, {mu} mu from xy {join}) t) u) v)"""
LDSC = ROWS + ", xy as (select n_eff * ell / (select count(*) from rows) x, chisq y, ell from rows), " + FIT.format(k=0, mu="1.0", join="") + ", " + FIT.format(k=1, mu="greatest(f0.a + f0.b * x, 1.0)", join=", f0") + ", " + FIT.format(k=2, mu="greatest(f1.a + f1.b * x, 1.0)", join=", f1")


def _ldsc_rows(spark, d):
    p = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(p.alias("vidx"), (p % 40 / 10.0 + 1).alias("ell"), (20000.0 + p % 100).alias("n_eff"), (((p * 37) % 101 - 50) / 1000.0).alias("beta"), F.lit(0.007).alias("se"))
    std = C.standardize_beta(F.col("beta"), F.col("se"), F.col("n_eff"))
    return qc.numbered(rows.withColumn("chisq", F.col("n_eff") * std * std), ["vidx"], "number")


@query("select round(f2.b, 8) + 0.0 h2, round(f2.a, 6) + 0.0 intercept, round((select avg(y) from xy), 6) + 0.0 mean_chisq from f2", LDSC)
def ldsc_h2(spark, d):
    return ldsc.h2(_ldsc_rows(spark, d), n_blocks=20).select((F.round("h2", 8) + 0.0).alias("h2"), r6("intercept").alias("intercept"), r6("mean_chisq").alias("mean_chisq"))


REPS = """ntile(least({n}, cast((select count(*) from {rows}) as bigint))) over (order by number) - 1 jk"""


def fits(name: str, x: str, y: str, rows: str) -> str:
    """Three weighted fits in SQL, each of all replicates (rep -1 leaves no block out)."""
    out = []
    for k in range(3):
        mean = "1.0" if k == 0 else f"greatest(f.a + f.b * {x}, 1.0)"
        source = f"reps r" if k == 0 else f"{name}{k - 1} f"
        rep = "r.rep" if k == 0 else "f.rep"
        out.append(f"{name}{k} as (select rep, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw a from (select rep, sum(w) sw, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy from (select {rep} rep, {x} x, {y} y, 1 / (2.0 * ({mean}) * ({mean})) / greatest(ell, 1.0) w from {rows} xy, {source} where {rep} = -1 or {rep} != xy.jk) t group by rep) u)")
    return ", ".join(out)


def jackknife(value: str, source: str) -> str:
    return f"(select sqrt((count(*) - 1.0) / count(*) * sum(power({value} - m, 2))) from {source}, (select avg({value}) m from {source} where rep >= 0) z where rep >= 0)"


H2_SE = ROWS + ", xy as (select n_eff * ell / (select count(*) from rows) x, chisq y, ell, " + REPS.format(n=200, rows="rows") + " from rows), reps as (select -1 rep union all select distinct jk from xy), " + fits("f", "x", "y", "xy")


@query(f"select round(f2.b, 8) + 0.0 h2, round({jackknife('b', 'f2')}, 6) + 0.0 h2_se, round(f2.a, 6) + 0.0 intercept, round({jackknife('a', 'f2')}, 6) + 0.0 intercept_se, round((select avg(y) from xy), 6) + 0.0 mean_chisq, round(case when (select avg(y) from xy) > 1 then (f2.a - 1) / ((select avg(y) from xy) - 1) end, 6) + 0.0 ratio from f2 where rep = -1", H2_SE)
def ldsc_h2_se(spark, d):
    return ldsc.h2(_ldsc_rows(spark, d)).select((F.round("h2", 8) + 0.0).alias("h2"), *(r6(c).alias(c) for c in ("h2_se", "intercept", "intercept_se", "mean_chisq", "ratio")))


RG = "rows as (select vidx number, ell, b1, b1 * 0.8 + (vidx * 17 % 13 - 6) / 2000.0 b2, n_eff n1, n_eff * 0.5 n2 from (select *, beta / sqrt(n_eff * se * se + beta * beta) b1 from (select p_partkey vidx, p_partkey % 40 / 10.0 + 1 ell, 20000.0 + p_partkey % 100 n_eff, ((p_partkey * 37) % 101 - 50) / 1000.0 beta, 0.007 se from part) t) u), " + "xy as (select number, ell, n1 * ell / m x1, n2 * ell / m x2, sqrt(n1 * n2) * ell / m xc, n1 * b1 * b1 y1, n2 * b2 * b2 y2, sqrt(n1 * n2) * b1 * b2 yc, " + REPS.format(n=200, rows="rows") + " from rows, (select count(*) m from rows) z), reps as (select -1 rep union all select distinct jk from xy), " + fits("f", "x1", "y1", "xy") + ", " + fits("g", "x2", "y2", "xy") + """, cross_fit as (select rep, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) b, (sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw a from (select rep, sum(w) sw, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy from
    (select f2.rep, xc x, yc y, 1.0 / (greatest(ell, 1.0) * greatest(f2.a + f2.b * x1, 1.0) * greatest(g2.a + g2.b * x2, 1.0)) w from xy, f2, g2 where f2.rep = g2.rep and (f2.rep = -1 or f2.rep != xy.jk)) t group by rep) u),
  corr_fit as (select c.rep, c.b / sqrt(greatest(f2.b * g2.b, 1e-12)) v, c.b gcov, c.a gint, f2.b h1, g2.b h2 from cross_fit c join f2 on f2.rep = c.rep join g2 on g2.rep = c.rep)"""


@query(f"select round(v, 6) + 0.0 rg, round({jackknife('v', 'corr_fit')}, 6) + 0.0 rg_se, round(gcov, 8) + 0.0 gcov, round(gint, 6) + 0.0 gcov_intercept, round(h1, 8) + 0.0 h2_1, round(h2, 8) + 0.0 h2_2 from corr_fit where rep = -1", RG)
def ldsc_rg(spark, d):
    rows = _ldsc_rows(spark, d).withColumn("b1", C.standardize_beta(F.col("beta"), F.col("se"), F.col("n_eff")))
    rows = rows.select("number", "ell", "b1", (F.col("b1") * 0.8 + (F.col("vidx") * 17 % 13 - 6) / 2000.0).alias("b2"), F.col("n_eff").alias("n1"), (F.col("n_eff") * 0.5).alias("n2"))
    digits = {"gcov": 8, "h2_1": 8, "h2_2": 8}
    return ldsc.rg(rows).select(*((F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in ("rg", "rg_se", "gcov", "gcov_intercept", "h2_1", "h2_2")))


ABF = "effects_w as (select e.vidx, e.n, w.weight from effects e join weights w on w.vidx = e.vidx), abf as (select vidx // 16 * 16 block_id, vidx, n, weight beta, 0.5 * (ln((1 / n) / (1 / n + 0.04)) + weight * weight * n * 0.04 / (1 / n + 0.04)) lbf from effects_w), pips as (select *, exp(lbf - mx) / sum(exp(lbf - mx)) over (partition by block_id) pip, 1 / (25.0 + n) var, 1 / (25.0 + n) * beta * n mu from (select *, max(lbf) over (partition by block_id) mx from abf) t)"


@query("select block_id, vidx, round(lbf, 6) + 0.0 lbf, round(pip, 6) + 0.0 pip, round(pip * mu, 6) + 0.0 mean, round(sqrt(greatest(pip * (var + mu * mu) - pip * mu * pip * mu, 0.0)), 6) + 0.0 sd, coalesce(sum(pip) over (partition by block_id order by pip desc, vidx rows between unbounded preceding and 1 preceding), 0.0) < 0.95 in_set from pips", ABF)
def finemap_abf(spark, d):
    rows = effects(spark, d).withColumn("block_id", F.expr("vidx div 16 * 16"))
    return finemap.single_signal(rows).select("block_id", "vidx", *(r6(c).alias(c) for c in ("lbf", "pip", "mean", "sd")), "in_set")


# --- models with exact answers: linear systems, solved in SQL by elimination ----------------------------

# rows of a block's matrix and, behind them, right-hand sides; after step k column k is that of the unit matrix
ELIMINATION = ", steps as (select block_id, 0 k, m from augmented union all select block_id, k + 1, list_transform(m, lambda row, i: case when i = k + 1 then list_transform(row, lambda v: v / m[k + 1][k + 1]) else list_transform(row, lambda v, j: v - row[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) end) from steps where k < " + f"{BLOCK}), solved as (select block_id, m from steps where k = {BLOCK})"
#: h2 of a block is its share; the median sample size stands for all.
INF = PAIRS + f", ridges as (select v.vidx // {BLOCK} * {BLOCK} block_id, {BLOCK} / (0.3 * {BLOCK} / (select count(*) from variants) * median(e.n)) ridge from variants v join effects e on e.vidx = v.vidx group by 1), augmented as (select block_id, list(list_append(row, weight) order by i) m from (select p.block_id, p.i, list(cast(cast(p.r as float) as double) + case when p.i = p.j then d.ridge else 0.0 end order by p.j) row from pairs p join ridges d on d.block_id = p.block_id group by p.block_id, p.i) t join weights w on w.vidx = t.block_id + t.i group by block_id)" + ELIMINATION


@query(f"select block_id + i.i - 1 vidx, round(m[i.i][{BLOCK + 1}], 6) + 0.0 beta from solved, (select unnest(generate_series(1, {BLOCK})) i) i", INF)
def model_inf(spark, d):
    return models.inf(*fitted_on(spark, d), 0.3).select("vidx", r6("beta").alias("beta"))


IMPUTE = PAIRS + f", p as (select block_id, i, j, cast(cast(r as float) as double) r, (block_id + i) % 5 != 2 ti, (block_id + j) % 5 != 2 tj from pairs), augmented as (select block_id, list(list_concat(row, rhs) order by i) m from (select block_id, i, list(case when ti and tj then r + case when i = j then 1e-3 else 0.0 end when i = j then 1.0 else 0.0 end order by j) row, list(case when ti and not tj then r else 0.0 end order by j) rhs from p group by block_id, i) t group by block_id)" + ELIMINATION


@query(f"""select p.block_id + p.j vidx, round(case when p.tj then max(e.weight) filter (p.i = p.j) when max(abs(p.r)) filter (p.ti) > 0 then sum(case when p.ti then s.m[p.i + 1][{BLOCK} + p.j + 1] * e.weight else 0.0 end) else 0.0 end, 6) + 0.0 beta,
    round(case when p.tj then max(e.n) filter (p.i = p.j) when max(abs(p.r)) filter (p.ti) > 0 then greatest(avg(e.n) filter (p.ti) * least(greatest(sum(case when p.ti then p.r * s.m[p.i + 1][{BLOCK} + p.j + 1] else 0.0 end), 0.0), 1.0), 1.0) else 1.0 end, 4) + 0.0 n,
    round(case when p.tj then 1.0 else least(greatest(sum(case when p.ti then p.r * s.m[p.i + 1][{BLOCK} + p.j + 1] else 0.0 end), 0.0), 1.0) end, 6) + 0.0 r2
    from p join solved s on s.block_id = p.block_id join (select w.vidx, w.weight, f.n from weights w join effects f on f.vidx = w.vidx) e on e.vidx = p.block_id + p.i group by p.block_id, p.j, p.tj""", IMPUTE)
def ld_imputation(spark, d):
    e = effects(spark, d).withColumn("typed", (F.col("vidx") % 5 != 2).cast("double"))
    return models.impute(blocks(spark, d), e).select("vidx", r6("beta").alias("beta"), (F.round("n", 4) + 0.0).alias("n"), r6("r2").alias("r2"))


# --- samplers: results are checked in tests against NumPy and known values ------------------------------


@query()
def model_grid(spark, d):
    return models.grid(*fitted_on(spark, d), 0.3, 0.1)


@query()
def model_auto(spark, d):
    return models.auto(*fitted_on(spark, d))[0]


@query()
def model_auto_rounds(spark, d):
    return models.auto_rounds(*fitted_on(spark, d))[0]


@query()
def model_infer(spark, d):
    return models.infer(*fitted_on(spark, d))[1]


@query()
def model_lassosum2(spark, d):
    return models.lassosum(*fitted_on(spark, d))[0]


@query()
def model_laplace(spark, d):
    return models.laplace(*fitted_on(spark, d), 0.3)


@query()
def model_annot(spark, d):
    e = effects(spark, d).withColumn("coding", (F.col("vidx") % 13 == 0).cast("double"))
    return models.annot(blocks(spark, d), e, ["coding"])[0]


@query()
def model_bivariate(spark, d):
    e = effects(spark, d).withColumns({"beta2": F.col("beta") * 0.5, "n2": F.col("n") * 0.5})
    return models.bivariate(blocks(spark, d), e)[0]


@query()
def dentist_filter(spark, d):
    e = effects(spark, d).withColumn("z", F.col("beta") * F.sqrt("n") * F.when(F.col("vidx") % 16 == 5, -3.0).otherwise(1.0))
    return models.dentist(blocks(spark, d), e, cutoff=10.0)


@query()
def finemap_pip(spark, d):
    return models.finemap(*fitted_on(spark, d)).select("vidx", "block_id", "pip", "mean", "sd", "signal")
