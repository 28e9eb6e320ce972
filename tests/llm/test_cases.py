"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns for every operator."""

import pytest

from prsloom.llm import decontaminate, hmm, language_id, near_dedup, packing, pii, substring_dedup, syncmers, tokens, url_rules

from .conftest import SCHEMA

OPERATORS = {
    "substring": lambda d, s: substring_dedup.substring_dedup(d, width_bits=18),
    "language": lambda d, s: language_id.identify(d),
    "tokens": lambda d, s: tokens.token_table(d),
    "pii": lambda d, s: pii.report(d),
    "redact": lambda d, s: pii.redact(d),
    "decontaminate": lambda d, s: decontaminate.judged(d, s.createDataFrame([(1, "one two three")], "item_id long, text string")),
    "cut": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(None, "x y"), (1, None), (2, "one")], "item_id long, text string")),
    "packing": lambda d, s: packing.best_fit_packing(d),
    "syncmers": lambda d, s: syncmers.fingerprints(d),
    "hmm": lambda d, s: hmm.score(d),
    "near": lambda d, s: near_dedup.near_duplicates(d),
    "without": lambda d, s: near_dedup.without_near_duplicates(d),
}
#: Rows returned for the odd table of 16 rows, three of which repeat an id.
ROWS = {"syncmers": 14, "packing": None, "without": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, documents, odd, name):
    docs = documents(odd).selectExpr("*", "'x' as key", "1 as n", "2 as rep", "'y' as spans", "3 as part", "'z' as signature", "4 as rid", "5 as kind")
    got = OPERATORS[name](docs, spark)
    rows = got.collect()
    want = ROWS.get(name, len(odd))
    assert rows and (want is None or len(rows) == want)
    assert any(r["doc_id"] is None for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), spark).collect() == []


def test_empty_pages(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_shared_folder_is_read_from_the_session(tmp_path):
    from types import SimpleNamespace

    from prsloom.llm import common

    session = SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/"})
    assert common.shared_dir(session) == str(tmp_path)
    unset = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local[2]"))
    assert common.shared_dir(unset) == common.shared_dir(unset)
    with pytest.raises(ValueError, match="checkpoint"):  # no folder of one machine on a cluster
        common.shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://a:7077")))
