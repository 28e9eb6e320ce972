import gzip

import numpy as np
import pytest

from prsloom.sources import text
from prsloom.sources.genotypes import load_genotypes, write_bgen, write_plink


def stats(spark, tmp_path, content, name="s.txt", **kw):
    path = tmp_path / name
    if name.endswith("gz"):
        with gzip.open(path, "wt") as f:
            f.write(content)
    else:
        path.write_text(content)
    return text.read_sumstats(spark, str(path), **kw).orderBy("row_no").collect()


def test_catalogue_dialect(spark, tmp_path):
    rows = stats(spark, tmp_path, "variant_id\tchromosome\tbase_pair_location\teffect_allele\tother_allele\tbeta\tstandard_error\tp_value\teffect_allele_frequency\tn\nrs1\t1\t100\ta\tg\t0.1\t0.02\t1e-3\t0.3\t1000\nrs2\t1\tNA\tC\tT\tNA\t0.02\t1\t\t1000\n")
    assert (rows[0].pos, rows[0].ea, rows[0].eaf, rows[0].n_eff) == (100, "A", 0.3, 1000)
    assert (rows[1].pos, rows[1].beta, rows[1].eaf) == (0, None, None)


def test_whitespace_odds_ratio(spark, tmp_path):
    rows = stats(spark, tmp_path, "SNPID CHR  POS A1 A2 OR SE P Neff\nrs1 1 5   A G 2.0 0.1 0.5 900\n\nrs2 1 6 A G -1 0.1 0.5 900\n")
    assert rows[0].beta == pytest.approx(np.log(2)) and rows[1].beta is None and rows[0].n_eff == 900


def test_comma_and_se_from_p(spark, tmp_path):
    rows = stats(spark, tmp_path, "SNP,CHR,POS,Allele1,Allele2,BETA,p.value,N\nrs1,1,5,A,G,0.1,0.05,900\nrs2,1,6,A,G,0.2,1e-300,900\n")
    assert rows[0].se == pytest.approx(0.1 / 1.959963985, rel=1e-6) and 0 < rows[1].se < 0.01


def test_gzip_override_and_fixed_n(spark, tmp_path):
    assert len(stats(spark, tmp_path, "SNP\tA1\tA2\tBETA\tSE\tN\nrs1\tA\tG\t1\t1\t9\nrs2\tA\tG\t1\t1\t9\n", "s.txt.gz")) == 2
    rows = stats(spark, tmp_path, "id\tref\talt\tEFF\tSEBETA\tnsamp\nx\tG\tA\t0.5\t0.1\t77\n", beta="EFF", n_eff="nsamp")
    assert (rows[0].ea, rows[0].oa, rows[0].beta, rows[0].n_eff) == ("A", "G", 0.5, 77)
    assert stats(spark, tmp_path, "SNP A1 A2 BETA SE\nr A G 1 1\n", n_eff=400000)[0].n_eff == 400000


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="oa"):
        stats(spark, tmp_path, "SNP A1 BETA SE N\nr A 1 1 5\n")
    with pytest.raises(ValueError, match="n_eff"):
        stats(spark, tmp_path, "SNP A1 A2 BETA SE\nr A G 1 1\n")


def cohort(n=13, m=7, seed=1):
    return np.random.default_rng(seed).integers(-1, 3, (n, m)).astype(np.int8)


def test_plink_round_trip(spark, tmp_path):
    g = cohort()
    write_plink(str(tmp_path / "a"), g, [(1, f"rs{k}", 0, 100 * k, "A", "G") for k in range(7)], [(f"f{k}", f"i{k}", 1, -9) for k in range(13)])
    got = load_genotypes(spark, str(tmp_path / "a.bed"))
    rows = {x.vidx: x.dosage for x in got.dosage.collect()}
    for v in range(7):
        assert rows[v] == [None if x < 0 else int(x) for x in g[:, v]]
    assert [x.id for x in got.variants.orderBy("vidx").collect()] == [f"rs{k}" for k in range(7)]
    assert got.samples.count() == 13


def test_bed_bits_and_errors(spark, tmp_path):
    (tmp_path / "b.bed").write_bytes(b"\x6c\x1b\x01\xe4")
    (tmp_path / "b.bim").write_text("1 rs1 0 5 a g\n")
    (tmp_path / "b.fam").write_text("".join(f"f i{k} 0 0 1 -9\n" for k in range(4)))
    assert load_genotypes(spark, str(tmp_path / "b")).dosage.collect()[0].dosage == [2, None, 1, 0]
    (tmp_path / "b.bed").write_bytes(b"\x00\x1b\x01\xe4")
    with pytest.raises(Exception, match="not a BED"):
        load_genotypes(spark, str(tmp_path / "b")).dosage.collect()


def test_filters_reach_the_ranges(spark, tmp_path):
    g = cohort()
    write_plink(str(tmp_path / "a"), g, [(1, f"rs{k}", 0, 100 * k, "A", "G") for k in range(7)], [(f"f{k}", f"i{k}", 1, -9) for k in range(13)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = load_genotypes(spark, str(tmp_path / "a")).dosage.filter("vidx in (1, 4)").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r.vidx for r in rows) == [1, 4] and rows[0].dosage[0] == (None if g[0, rows[0].vidx] < 0 else g[0, rows[0].vidx])


@pytest.mark.parametrize(("bits", "compress"), [(8, True), (8, False), (16, True), (11, True)])
def test_bgen_round_trip(spark, tmp_path, bits, compress):
    g = cohort()
    path = str(tmp_path / "a.bgen")
    write_bgen(path, g, [(f"rs{k}", 1, k + 1, "A", "G") for k in range(7)], [f"s{k}" for k in range(13)], bits, compress)
    got = load_genotypes(spark, path)
    rows = {x.vidx: x.dosage for x in got.dosage.filter("vidx in (2, 5)").collect()}
    assert set(rows) == {2, 5}
    assert rows[5] == [None if x < 0 else float(x) for x in g[:, 5]]
    assert [x.iid for x in got.samples.orderBy("sidx").collect()][3] == "s3"


def test_annotations_regions_weights(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SNP coding cons\nrs1 1 0.5\nrs2 x 1\n")
    rows, names = text.read_annotations(spark, str(tmp_path / "a.txt"))
    assert names == ["coding", "cons"] and [tuple(x)[1:] for x in rows.collect()] == [("rs1", 1.0, 0.5)]
    (tmp_path / "r.bed").write_text("# c\n1 5 9 first\n2 1 3\n")
    assert [tuple(x) for x in text.read_regions(spark, str(tmp_path / "r.bed")).collect()] == [("1", 5, 9, "first"), ("2", 1, 3, None)]
    w = spark.createDataFrame([("rs1", "1", 5, "A", "G", 0.123456789)], "id string, chrom string, pos long, a1 string, a2 string, weight double")
    text.write_weights(w, str(tmp_path / "w"))
    assert text.read_weights(spark, str(tmp_path / "w")).collect()[0].weight == pytest.approx(0.12345679)
