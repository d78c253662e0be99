"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language, licenses, near, perplexity, pii, rules, sharding
from . import kernel as K

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs), keep=["doc_id"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.fit(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.decided(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.duplicates(table(spark, sf_dir, "documents"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return perplexity.scored(docs, perplexity.fit(docs))


def op7_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"])


def _placed(docs: DataFrame) -> DataFrame:
    """docs with a path. The tables hold none, so each source is laid out as a tree: a folder for every thousand ids, and
    every other twenty of them in folders of a hundred below it. Documents of at most 1,000 characters are named like
    licence files; the scan decides which of them hold a licence."""
    name = F.concat(F.when(F.length("text") <= 1000, "LICENSE.").otherwise(""), F.col("doc_id").cast("string"))
    below = F.expr("if(doc_id div 20 % 2 = 1, string(doc_id div 100), null)")
    return docs.withColumn("path", F.concat_ws("/", "source", F.expr("string(doc_id div 1000)"), below, name))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_placed(table(spark, sf_dir, "documents")), "path")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_language, op3_pii, op4_quality, op5_near_duplicates, op6_perplexity, op7_shuffle, op8_chat, op9_bpe, op10_licenses, pipeline)
    return {f.__name__: f for f in own}


_WORDS = f"list_filter(regexp_extract_all(lower(text), '{K.WORD_RE2}'), lambda w: w <> '')"
_GRAMS = "unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))"


def oracle_sql() -> dict[str, str]:
    """Exact containment of every document and item; items have at least five words in these tables."""
    return {
        "op1_decontaminate": f"""
            WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            ig AS (SELECT DISTINCT item_id, {_GRAMS} AS g FROM i),
            dg AS (SELECT DISTINCT doc_id, {_GRAMS} AS g FROM d),
            n AS (SELECT item_id, count(*) AS size FROM ig GROUP BY item_id)
            SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(size)::BIGINT AS size, count(*)::DOUBLE / any_value(size) AS containment
            FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id
            HAVING count(*) >= 0.6 * any_value(size)""",
    }
