"""The training-data pipeline over `documents`: each stage is one operator, written and read again."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import common, decontaminate, line_dedup, ngram_join, packing, quality
from brindle.llm.common import materialise
from brindle.llm.queries import tokenizer_path


_scratch: list[str] = []


def _tidy(stage, first: bool):
    """Before a stage, delete the scratch tables of the one before it, whose output is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            common.delete_paths(spark, _scratch)
        _scratch.clear()
        before = common.paths(spark)
        out = stage(spark, docs, sf_dir)
        _scratch.extend(common.paths(spark) - before)
        return out

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
STAGES = [(name, _tidy(stage, i == 0)) for i, (name, stage) in enumerate(STAGES)]

#: Tokenisation has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
