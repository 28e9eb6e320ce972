"""Plans that must hold at any size: what grows is neither sorted for a join nor computed again and again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prsloom.functions import columns as C
from prsloom.functions import kernels
from prsloom.operators import harmonize, ld, models, qc
from prsloom.tables import once

SS = "row_no long, id string, chrom string, pos long, ea string, oa string, beta double, se double, n_eff double, eaf double, info double"


@pytest.fixture
def large(spark):
    """Plans as for tables too large to broadcast."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def statistics(spark):
    rows = [(k, ["rs1", "rs2", "", ".", None, "rs9"][k % 6], "chr1", 100 * (k % 3), *("AG", "GA", "TC", "CT", "AT", "AC")[k % 6], None if k == 7 else 0.1, 0.01, 1000.0, 0.3, 0.9) for k in range(60)]
    return spark.createDataFrame(rows, SS)


def panel(spark):
    return spark.createDataFrame([(0, "rs1", "1", 0, "a", "g"), (1, "rs2", "01", 100, "A", "G"), (2, "", "1", 100, "A", "G"), (3, ".", "Chr1", 200, "G", "A"), (4, "rs1", "1", 0, "A", "C")], "vidx long, id string, chrom string, pos long, a1 string, a2 string")


def test_statistics_are_not_sorted_to_meet_the_panel(large):
    rows = harmonize.aligned(statistics(large), panel(large))
    assert "SortMergeJoin" not in plan(rows)
    assert "xxhash64(row_no" in plan(rows)  # rows without an id do not share a task


def test_alignment_by_hand(large):
    rows = harmonize.aligned(statistics(large), panel(large)).collect()
    names, places = {"rs1": 0, "rs2": 1}, {0: 0, 100: 2, 200: 3}
    by_pair = {"AG": "keep", "GA": "swap", "TC": "strand_keep", "CT": "strand_swap", "AT": "palindrome", "AC": "mismatch"}
    turned = {"keep": "swap", "swap": "keep", "strand_keep": "strand_swap", "strand_swap": "strand_keep"}
    assert len(rows) == 60
    for x in rows:
        assert x.vidx == names.get(x.id, places[x.pos])
        want = by_pair[x.ea + x.oa]
        if x.vidx == 3:
            want = turned.get(want, want)
        if x.row_no == 7:
            want = "nonfinite"
        assert x.action == want, x
    ok = {}
    for x in rows:
        if x.ok:
            ok[x.vidx] = min(x.row_no, ok.get(x.vidx, 99))
    assert all(x.winner == ok.get(x.vidx) and x.counted == (x.winner is None or x.row_no <= x.winner) for x in rows)


def test_chromosomes(spark):
    given = {"chr1": "1", " CHRx ": "X", "cHr23": "X", "24": "Y", "25": "XY", "26": "MT", "m": "MT", "chrM": "MT", "chr": "", "chrchr1": "CHR1", "1chr": "1CHR", "": "", "chr 1": " 1", None: None}
    rows = spark.createDataFrame([(x,) for x in given], "c string").select("c", C.norm_chrom(F.col("c")).alias("n")).collect()
    assert {x.c: x.n for x in rows} == given


def test_quality_control_sorts_neither_rows_nor_keys(large):
    rows = qc.flagged(statistics(large).withColumn("id", F.when(F.col("row_no") < 40, F.concat(F.lit("x"), F.col("row_no"))).otherwise(F.col("id"))))
    assert "SortMergeJoin" not in plan(rows)
    assert {x.row_no for x in rows.filter("reason = 'duplicate'").collect()} == set(range(40, 60)) - {x.row_no for x in rows.filter("reason is null").collect()} - {7}
    keys = {}
    for x in rows.collect():
        keys.setdefault(("i", x.id) if x.id not in (None, "", ".") else ("p", x.chrom, x.pos, x.ea, x.oa), []).append(x)
    assert all((x.reason == "duplicate") == (len(v) > 1) for v in keys.values() for x in v if x.row_no != 7)


def test_models_compute_their_blocks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def build(frames):
        for frame in frames:
            for b in frame["block_id"]:
                seen.add(1)
                yield pd.DataFrame([ld._encode(int(b), int(b), kernels.Dense(np.eye(4)))])

    lazy = spark.range(0, 12, 4).withColumnRenamed("id", "block_id").mapInPandas(build, ld.BLOCK)
    effects = spark.range(12).select(F.col("id").alias("vidx"), (F.col("id") / 100).alias("beta"), F.lit(1000.0).alias("n"))
    assert models.lassosum(lazy, effects)[0].count() == 12
    assert seen.value == 3
    table = once(lazy, "again")
    assert once(table, "again") is table
