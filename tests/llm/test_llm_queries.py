import sys
from pathlib import Path

import pytest

pytest.importorskip("fenceline.llm")

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import check, connect  # noqa: E402

from fenceline.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    check(connect(FOLDER), spark, FOLDER, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_mixture_reaches_its_shares(spark):
    report = {r["source"]: r for r in queries.p7_shares(spark, "/root/testdata/sf0.01").collect()}
    for r in report.values():
        assert r["most_copies"] <= r["max_repeats"] and r["given_tokens"] <= r["asked_tokens"] + 20_000
    assert report["radio_play"]["actual_share"] == 0
    able = sum(r["target_share"] for r in report.values() if r["n_docs"])
    longest = 45_000 / sum(r["given_tokens"] for r in report.values())
    for r in report.values():
        if r["n_docs"]:
            assert abs(r["actual_share"] - r["target_share"] / able) <= longest / 2


def test_containers_are_full(spark):
    for r in queries.p6_fill(spark, "/root/testdata/sf0.01").collect():
        assert r["fullest"] <= r["capacity_tokens"] and r["used"] > 0.99 and r["n_containers"] <= 1.01 * r["least_containers"]


def test_each_document_gets_one_language_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES["p8_languages"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all((r["lang"] is None) == (r["confidence"] is None) for r in got) and any(r["lang"] for r in got)
