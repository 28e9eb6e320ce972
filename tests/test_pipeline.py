"""A simulated cohort through files: fit, freeze, score, fine-map."""

import json

import numpy as np
import pytest

from prsloom import cli
from prsloom.plans import pipeline
from prsloom.sources.genotypes import write_plink

M, N = 120, 600


def write_cohort(d, prefix, g, order=None, swapped=()):
    order = range(g.shape[1]) if order is None else order
    calls = np.stack([np.where(g[:, k] < 0, g[:, k], 2 - g[:, k]) if k in swapped else g[:, k] for k in order], 1).astype(np.int8)
    write_plink(str(d / prefix), calls, [(1, f"rs{k}", 0, k + 1, *(("G", "A") if k in swapped else ("A", "G"))) for k in order], [(f"f{k}", f"i{k}", 1, -9) for k in range(len(g))])
    return str(d / prefix)


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    d = tmp_path_factory.mktemp("cohort")
    rng = np.random.default_rng(1)
    af = rng.uniform(0.1, 0.9, M)
    g = rng.binomial(2, af, (N, M)).astype(np.int8)
    beta = np.where(rng.random(M) < 0.15, rng.standard_normal(M), 0)
    z = (g - g.mean(0)) / g.std(0)
    true = z @ beta
    true *= np.sqrt(0.6) / true.std()
    y = true + rng.standard_normal(N) * np.sqrt(0.4)
    hat = z.T @ (y - y.mean()) / y.std() / N
    lines = ["SNP\tCHR\tBP\tA1\tA2\tBETA\tSE\tN"]
    for k in range(M):
        a, b, e = ("A", "G", hat[k]) if k % 3 else ("G", "A", -hat[k])
        lines.append(f"rs{k}\t1\t{k + 1}\t{a}\t{b}\t{e / g[:, k].std():.8g}\t{1 / np.sqrt(N) / g[:, k].std():.8g}\t{N}")
    (d / "gwas.txt").write_text("\n".join(lines) + "\n")
    write_cohort(d, "g", g)
    return d, true, g


def scores_of(found):
    return np.array([r.score for r in found.scores.orderBy("sidx").collect()])


def test_fit_freeze_and_score(spark, cohort):
    d, true, g = cohort
    found = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), method="inf", h2=0.5, block_size=40, ld_out=str(d / "ld"))
    got = scores_of(found)
    assert np.corrcoef(got, true)[0, 1] ** 2 > 0.4
    assert found.log["n_final"] == M and found.log["n_flipped"] == M // 3
    frozen = pipeline.score_from_weights(spark, found.weights.withColumnRenamed("vidx", "row_no"), str(d / "g"), scaling="frozen")
    np.testing.assert_allclose(scores_of(frozen), got, atol=1e-6)
    # the cache is met by id: other orders and other first alleles give the same scores
    again = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), method="inf", h2=0.5, ld_cache=str(d / "ld"))
    np.testing.assert_allclose(scores_of(again), got, atol=1e-6)
    mixed = write_cohort(d, "mixed", g, np.random.default_rng(2).permutation(M), swapped={3, 40, 77})
    again = pipeline.run_prs(spark, str(d / "gwas.txt"), mixed, method="inf", h2=0.5, ld_cache=str(d / "ld"))
    np.testing.assert_allclose(scores_of(again), got, atol=1e-6)


def test_a_cache_of_other_variants_is_refused(spark, cohort):
    d, _, g = cohort
    half = write_cohort(d, "half", g, range(0, 80))
    other = write_cohort(d, "other", g, range(40, 120))
    pipeline.run_prs(spark, str(d / "gwas.txt"), half, method="inf", h2=0.5, ld_out=str(d / "ld80"))
    with pytest.raises(ValueError, match="absent here.*rs0"):  # as many variants, but not the same
        pipeline.run_prs(spark, str(d / "gwas.txt"), other, method="inf", h2=0.5, ld_cache=str(d / "ld80"))
    with pytest.warns(UserWarning, match="cache"):
        pipeline.run_prs(spark, str(d / "gwas.txt"), half, method="inf", h2=0.5, ld_cache=str(d / "ld80"), dentist=True)


def test_a_panel_with_repeated_ids(spark, cohort):
    d, _, g = cohort
    panel = write_cohort(d, "panel", np.concatenate([g, g], 1)[:, [*range(M), 5, 5, 9]], None)
    # columns M and up repeat ids of earlier variants
    rows = (d / "panel.bim").read_text().splitlines()
    (d / "panel.bim").write_text("\n".join(r.replace(f"rs{k}\t", f"rs{[5, 5, 9][k - M]}\t") if k >= M else r for k, r in enumerate(rows)) + "\n")
    one = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), method="inf", h2=0.5)
    two = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), method="inf", h2=0.5, ld_prefix=panel)
    assert two.log["n_final"] == M
    np.testing.assert_allclose(scores_of(two), scores_of(one), atol=1e-6)


def test_auto_chains_and_priors(spark, cohort):
    d, true, _ = cohort
    found = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), block_size=60, auto_chains=3, infer=True, burn_in=20, num_iter=30)
    assert 0 < found.estimates["h2_est"] <= 1 and found.estimates["n_chains"] == 3
    assert np.corrcoef(scores_of(found), true)[0, 1] > 0.6
    found = pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), block_size=60, alpha=-0.5, burn_in=20, num_iter=30)
    assert np.corrcoef(scores_of(found), true)[0, 1] > 0.6
    with pytest.raises(ValueError, match="alpha"):
        pipeline.run_prs(spark, str(d / "gwas.txt"), str(d / "g"), method="inf", alpha=0.0)


def test_command_line(spark, cohort, capsys):
    d, _, _ = cohort
    given = ["--sumstats", str(d / "gwas.txt"), "--plink", str(d / "g")]
    assert cli.main([*given, "--dry-run"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["harmonize"]["n_matched"] == 120 and told["missing"] == [] and told["warnings"] == [] and told["columns"]["n_eff"] == "N"
    assert cli.main([*given, "--method", "lassosum2", "--out", str(d / "o.txt"), "--save-weights", str(d / "w.tsv"), "--prs-percentiles"]) == 0
    assert cli.main(["--weights", str(d / "w.tsv"), "--plink", str(d / "g"), "--scaling", "frozen", "--out", str(d / "p.txt")]) == 0
    assert spark.read.text(str(d / "p.txt")).first().value == "FID\tIID\tPRS"
    assert spark.read.text(str(d / "o.txt")).first().value == "FID\tIID\tPRS\tZ\tPCT"
    assert cli.main([*given, "--finemap", "--out", str(d / "fm"), "--burn-in", "10", "--num-iter", "20", "--finemap-min-purity", "0.1", "--finemap-coverage", "0.9"]) == 0
    assert spark.read.text(str(d / "fm.pip.tsv")).count() == M + 1
    assert spark.read.text(str(d / "fm.cs.tsv")).first().value.endswith("purity_min_abs_r\tpurity_mean_abs_r\tvariants")
    with pytest.raises(SystemExit):
        cli.main([*given, "--n-cases", "10", "--out", "x"])


def test_preflight_reports_missing_columns(spark, cohort):
    d, _, _ = cohort
    (d / "bad.txt").write_text("SNP\tBETA\nrs1\t0.1\n")
    told = pipeline.preflight(spark, str(d / "bad.txt"), "ignored")
    assert told["missing"] == ["ea", "oa", "n_eff"] and told["warnings"]


def test_finemap_regions(spark, cohort):
    d, _, _ = cohort
    (d / "r.bed").write_text("1 1 40\n")
    found = pipeline.run_finemap(spark, str(d / "gwas.txt"), str(d / "g"), regions=str(d / "r.bed"), n_chains=1, burn_in=20, num_iter=30)
    rows = found.variants.collect()
    assert len(rows) == 40 and all(0 <= r.pip <= 1 for r in rows)
    with pytest.raises(ValueError, match="no statistic"):
        pipeline.run_prs(spark, spark.createDataFrame([(0, "zz", "9", 1, "A", "G", 0.1, 0.1, 10.0, None, None)], "row_no long, id string, chrom string, pos long, ea string, oa string, beta double, se double, n_eff double, eaf double, info double"), str(d / "g"))
