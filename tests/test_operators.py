import numpy as np
import pytest
from pyspark.sql import functions as F

from prsloom.operators import harmonize, ld, ldsc, models, qc, score

SS = "row_no long, id string, chrom string, pos long, ea string, oa string, beta double, se double, n_eff double, eaf double, info double"
PANEL = "vidx long, id string, chrom string, pos long, a1 string, a2 string"


def ss(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SS)


def plain(k, **kw):
    row = {"id": f"rs{k}", "chrom": "1", "pos": k + 1, "ea": "A", "oa": "G", "beta": 0.1, "se": 0.02, "n_eff": 1000.0, "eaf": 0.3, "info": 0.99} | kw
    return tuple(row.values())


def test_qc_counts_each_rule(spark):
    rows = [plain(0, beta=None), plain(1, se=0.0), plain(2, se=float("nan")), plain(3, n_eff=600.0), plain(4, eaf=0.005), plain(5, info=0.5), plain(6), plain(6), plain(7, beta=9.0), plain(8, id="."), plain(9, id="."), plain(10, n_eff=None)]
    log = qc.counts(qc.flagged(ss(spark, rows), max_chisq=1000.0)).collect()[0]
    assert (log.n_nonfinite, log.n_low_n, log.n_low_maf, log.n_low_info, log.n_duplicate, log.n_high_chisq, log.n_out) == (3, 1, 1, 1, 2, 1, 3)


def test_qc_without_optional_columns(spark):
    rows = [plain(k, eaf=None, info=None) for k in range(3)]
    assert qc.passed(ss(spark, rows)).count() == 3


def panel(spark):
    a = [("A", "G"), ("C", "T"), ("A", "C"), ("A", "G"), ("G", "C")]
    return spark.createDataFrame([(k, f"rs{k + 1}", "1", 100 * (k + 1), *x) for k, x in enumerate(a)], PANEL)


def test_harmonise_truth_table(spark):
    rows = ss(spark, [plain(1, ea="A", oa="G", beta=0.2), plain(2, ea="T", oa="C", beta=-0.3), plain(3, ea="T", oa="G", beta=0.4), plain(4, ea="A", oa="T", beta=0.5), plain(5, ea="C", oa="A", beta=0.6)])
    found = harmonize.aligned(rows, panel(spark))
    assert {x.vidx: x.beta for x in harmonize.harmonized(found).collect()} == {0: 0.2, 1: 0.3, 2: 0.4}
    log = harmonize.log(found).collect()[0]
    assert (log.n_matched, log.n_flipped, log.n_strand_flipped, log.n_palindrome, log.n_mismatch) == (3, 1, 1, 1, 1)


def test_harmonise_by_position_and_first_success(spark):
    rows = ss(spark, [plain(9, id="", chrom="chr1", pos=200, ea="C", oa="T"), plain(1, ea="A", oa="C"), plain(1, ea="A", oa="G", beta=0.7), plain(1, ea="C", oa="T"), plain(1, beta=0.9)])
    found = harmonize.aligned(rows, panel(spark))
    assert {x.vidx: x.beta for x in harmonize.harmonized(found).collect()} == {1: 0.1, 0: 0.7}
    assert harmonize.log(found).collect()[0].n_mismatch == 1  # rows after the winner count nowhere


def test_build_mismatch(spark):
    rows = ss(spark, [plain(k, pos=999100 + k) for k in range(1, 6)])
    told = harmonize.diagnose(rows, panel(spark)).collect()[0]
    assert told.build_mismatch and told.n_id_overlap == 5 and told.n_pos_overlap == 0


def dosage(spark, g):
    return spark.createDataFrame([(v, [None if x < 0 else float(x) for x in g[:, v]]) for v in range(g.shape[1])], "vidx long, dosage array<double>")


def test_scores_match_numpy(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(-1, 3, (50, 6))
    g[:, 2] = 1
    g[:, 3] = -1
    w = rng.standard_normal(6)
    x = np.where(g < 0, np.nan, g).astype(float)
    mean = np.where(np.isnan(x).all(0), 0, np.nanmean(np.where(np.isnan(x).all(0), 0, x), 0))
    filled = np.where(np.isnan(x), mean, x)
    sd = filled.std(0)
    z = np.where(sd > 1e-12, (filled - mean) / np.where(sd > 0, sd, 1), 0)
    weights = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "vidx long, weight double")
    for flag, want in ((True, z @ w), (False, filled @ w)):
        got = [r.score for r in score.scores(dosage(spark, g), weights, standardize=flag).orderBy("sidx").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9)
    with pytest.raises(ValueError, match="frozen"):
        score.scores(dosage(spark, g), weights, frozen=True)
    stats = {r.vidx: r for r in score.dosage_stats(dosage(spark, g)).collect()}
    assert stats[3].af == 0 and stats[3].sd == 0


def test_ties_share_their_rank(spark):
    s = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1, 2, 2, 3])], "sidx long, score double")
    assert [r.pct for r in score.ranked(s).orderBy("sidx").collect()] == [0.125, 0.5, 0.5, 0.875]


def test_block_bounds_follow_runs(spark):
    v = spark.createDataFrame(list(enumerate("1112211")), "vidx long, chrom string")
    got = [(r.vidx, r.block_id, r.place) for r in ld.block_bounds(v, 2).orderBy("vidx").collect()]
    assert got == [(0, 0, 0), (1, 0, 1), (2, 2, 0), (3, 3, 0), (4, 3, 1), (5, 5, 0), (6, 5, 1)]


def test_ld_matches_numpy(spark):
    g = np.random.default_rng(6).integers(0, 3, (80, 5))
    bounds = spark.createDataFrame([(k, 0, k) for k in range(5)], "vidx long, block_id long, place long")
    got = {(r.i, r.j): r.r for r in ld.pairs(ld.compute_blocks(dosage(spark, g), bounds)).collect()}
    want = np.corrcoef(g.T)
    assert all(abs(got[i, j] - want[i, j]) < 1e-6 for i in range(5) for j in range(5))


def test_ldsc_recovers_h2(spark):
    rng = np.random.default_rng(8)
    m, n, h2 = 4000, 50000, 0.4
    ell = rng.uniform(1, 30, m)
    chisq = (1 + n * h2 * ell / m) * rng.chisquare(1, m)
    rows = spark.createDataFrame([(k, float(c), float(e), float(n)) for k, (c, e) in enumerate(zip(chisq, ell, strict=True))], "number long, chisq double, ell double, n_eff double")
    told = ldsc.h2(rows, n_blocks=20).collect()[0]
    assert abs(told.h2 - h2) < 4 * told.h2_se + 0.05 and told.h2_se > 0
    assert abs(ldsc.h2(rows, n_blocks=5, intercept=1.0).collect()[0].h2 - h2) < 0.1


def test_jackknife_blocks_split_like_arrays(spark):
    got = [r.b for r in spark.range(11).select(ldsc.jackknife_block(F.col("id"), F.lit(11), F.lit(4)).alias("b")).collect()]
    assert got == [k for k, part in enumerate(np.array_split(np.arange(11), 4)) for _ in part]


def simulated_blocks(spark, seed=3):
    rng = np.random.default_rng(seed)
    r = 0.5 ** np.abs(np.subtract.outer(np.arange(40), np.arange(40)))
    rows, effects = [], []
    for b in range(3):
        beta = np.where(rng.random(40) < 0.1, rng.standard_normal(40) * 0.1, 0)
        hat = r @ beta + np.linalg.cholesky(r) @ rng.standard_normal(40) / 200
        rows.append((b * 40, b * 40, 40, "dense", None, None, bytearray(r.astype(np.float32).tobytes())))
        effects += [(b * 40 + k, float(hat[k]), 40000.0) for k in range(40)]
    return spark.createDataFrame(rows, ld.BLOCK), spark.createDataFrame(effects, "vidx long, beta double, n double")


def test_models_over_blocks(spark):
    blocks, effects = simulated_blocks(spark)
    beta = {r.vidx: r.beta for r in models.inf(blocks, effects, 0.3).collect()}
    assert sorted(beta) == list(range(120))
    auto, told = models.auto(blocks, effects, burn_in=30, num_iter=50)
    rounds, told2 = models.auto_rounds(blocks, effects, rounds=4, burn_rounds=3, sweeps=15)
    a, b = ({r.vidx: r.beta for r in x.collect()} for x in (auto, rounds))
    assert np.corrcoef([a[k] for k in range(120)], [b[k] for k in range(120)])[0, 1] > 0.95
    assert abs(told["h2_est"] - told2["h2_est"]) < 0.1
    best, grid = models.lassosum(blocks, effects)
    assert best.count() == 120 and grid.count() == 60


def test_finemap_skips_quiet_blocks(spark):
    blocks, effects = simulated_blocks(spark)
    quiet = effects.withColumn("beta", F.when(F.col("vidx") < 40, 0.0).otherwise(F.col("beta")))
    found = models.finemap(blocks, quiet, only_significant=5e-8, n_chains=1, burn_in=20, num_iter=30)
    assert found.filter("vidx < 40").count() == 0 and found.count() > 0


def test_pooled_chains_do_not_depend_on_partitioning(spark):
    """Blocks in one task, in several by sockets, or by rounds: the same streams, sums that do not depend on their order."""
    from prsloom.operators import pooled

    blocks, effects = simulated_blocks(spark)
    options = {"burn_in": 20, "num_iter": 30}
    many = {r.vidx: r.beta for r in models.auto(blocks, effects, **options)[0].collect()}
    before = pooled.tasks
    pooled.tasks = lambda rows, n: 1
    try:
        one = {r.vidx: r.beta for r in models.auto(blocks, effects, **options)[0].collect()}
    finally:
        pooled.tasks = before
    assert many == one
    told = models.infer(blocks, effects, n_chains=3, **options)[1].collect()[0]
    assert told.n_chains == 3 and told.h2_low <= told.h2_est <= told.h2_high
    annotated = effects.withColumn("coding.1", (F.col("vidx") % 2).cast("double"))
    beta, told = models.annot(blocks, annotated, ["coding.1"], **options)
    assert beta.count() == 120 and set(told["enrichment"]) == {"intercept", "coding.1"} and len(models.top_enrichments(told["enrichment"])) == 1
    both = effects.withColumns({"beta2": -F.col("beta"), "n2": F.col("n")})
    assert models.bivariate(blocks, both, **options)[1]["rg"] < 0


def test_priors_of_single_variants(spark):
    blocks, effects = simulated_blocks(spark)
    flat = {r.vidx: r.beta for r in models.grid(blocks, effects, 0.3, 0.1, burn_in=10, num_iter=20).collect()}
    ones = {r.vidx: r.beta for r in models.grid(blocks, effects.withColumns({"prior": F.lit(1.0), "slab": F.lit(1.0)}), 0.3, 0.1, burn_in=10, num_iter=20).collect()}
    assert all(abs(flat[k] - ones[k]) < 1e-9 for k in flat)
    none = {r.vidx: r.beta for r in models.grid(blocks, effects.withColumn("prior", F.when(F.col("vidx") < 40, 0.0).otherwise(1.0)), 0.3, 0.1, burn_in=10, num_iter=20).collect()}
    small = [k for k in range(40) if abs(flat[k]) < 0.01]  # strong signals outweigh even the least prior
    assert sum(abs(none[k]) for k in small) < 0.5 * sum(abs(flat[k]) for k in small)
    with pytest.raises(ValueError, match="prior"):
        models.auto(blocks, effects.withColumn("prior", F.lit(1.0)))


def test_no_lasso_model_of_score_one(spark):
    blocks, effects = simulated_blocks(spark)
    best, _ = models.lassosum(blocks, effects.withColumn("beta", F.col("beta") * 100))
    assert best.count() == 120 and best.filter("beta != 0").count() == 0


def test_a_replicate_is_predicted(spark):
    from prsloom.operators import simulate

    told = simulate.run_one(spark, 800, 0.6, 0.1, m=60, block_size=30, n_test=200, burn_in=20, num_iter=40)
    assert told["r2"] > 0.4
    g = simulate.mosaic_genotypes(300, 50, np.random.default_rng(1))
    near = abs(np.corrcoef(g.T))
    assert g.shape == (300, 50) and set(np.unique(g)) <= {0, 1, 2} and np.diag(near, 1).mean() > np.diag(near, 20).mean()
