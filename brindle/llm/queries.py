"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, html_text, langid, licenses, line_dedup, ngram_join, oracles, packing, quality, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark, sf_dir):
    return quality.assess(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_url_filters(spark, sf_dir):
    return urlfilter.apply(_table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 9) for c in ("block_mean", "block_bound")})


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_html_extraction(spark, sf_dir):
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.remove(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scans(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.quality_sql(), "op5_url_filters": oracles.url_sql()}
