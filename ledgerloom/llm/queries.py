"""The registered queries of the operators: each reads its whole table and returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import sql
from ledgerloom.llm.common import table, written


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import language

    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerloom.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import url_rules

    pages = table(spark, sf_dir, "pages")
    judged = url_rules.judge(pages, written(url_rules.evidence(pages), "url-evidence"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import near_dedup

    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import licenses

    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return licenses.scan(table(spark, sf_dir, "documents")).select(*columns)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import main_text

    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import conversation_repair

    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.llm import fill_middle

    return fill_middle.transform(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality, "op2_language": op2_language, "op3_topk": op3_topk, "op4_bpe": op4_bpe, "op5_urls": op5_urls,
        "op6_near_dedup": op6_near_dedup, "op7_exact_dedup": op7_exact_dedup, "op8_mixing": op8_mixing, "op9_toxicity": op9_toxicity,
        "op10_licenses": op10_licenses, "op11_main_text": op11_main_text, "op12_repair": op12_repair, "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": sql.OP7, "op8_mixing": sql.OP8, "op3_topk": sql.OP3, "op13_fill_middle": sql.OP13}
