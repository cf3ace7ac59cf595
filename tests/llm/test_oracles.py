"""The SQL oracles of this subpackage, on the smallest tables."""

from __future__ import annotations

import pytest

import parity
from brindle.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    assert parity.compare(spark, parity.connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_the_oracle_sees_a_rejected_host(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(80))
    marks = good + " # $ % | < > & * # $"
    twice = "\n".join([good, good, *["a line of it"] * 30])
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(400)]
    rows += [(1000 + i, good if i % 10 else "short", f"h{i % 9}") for i in range(400)]
    rows += [(2000 + i, marks if i % 4 else good, "signs") for i in range(200)] + [(3000 + i, twice if i % 4 else good, "lines") for i in range(200)]
    rows += [(4000, good, None), (4001, None, "few"), (4002, marks, "few"), (4003, "short", "few2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/documents")
    (part,) = [f for f in (tmp_path / "documents").iterdir() if f.name.startswith("part")]
    part.rename(tmp_path / "documents.parquet")
    sf, run = str(tmp_path), queries.queries()["op1_quality_rules"]
    assert parity.compare(spark, parity.connect(sf), sf, run, queries.oracle_sql()["op1_quality_rules"]) == ""
    assert {r[0] // 1000 for r in run(spark, sf).where("host_rejected").select("doc_id").collect()} == {0, 2, 3}
