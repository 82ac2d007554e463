"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram vocabulary."""
    from lodegraph.llm.token_count import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("piece_bpe_32k.model"), whole=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 4096 tokens."""
    from lodegraph.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary("word_bpe_49k.json"), with_ids=False)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    from lodegraph.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0", 20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of the labelled ones."""
    from lodegraph.llm.langid import fit, held_out, identify

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("not held_out"))
    return identify(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: three-word shingles, similarity 0.85."""
    from lodegraph.llm.near_dup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source."""
    from lodegraph.llm.mixing import label_weights, mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality=label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    from lodegraph.llm.chat import digests, expand, format_turns, with_probe

    return digests(expand(format_turns(with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of equal label: cosine 0.98."""
    from lodegraph.llm.vector_dup import vector_duplicates

    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    from lodegraph.llm.sharding import shard

    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    from lodegraph.llm.url_filter import judge, listed_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, listed_urls(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_packing": op2_packing,
        "op3_nearest": op3_nearest,
        "op4_language_id": op4_language_id,
        "op5_near_dedup": op5_near_dedup,
        "op6_mixing": op6_mixing,
        "op7_chat_format": op7_chat_format,
        "op8_vector_dedup": op8_vector_dedup,
        "op9_sharding": op9_sharding,
        "op10_url_filter": op10_url_filter,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from lodegraph.llm import ann, chat, mixing, near_dup, sharding, url_filter, vector_dup

    return {
        "op3_nearest": ann.SQL,
        "op5_near_dedup": near_dup.SQL,
        "op6_mixing": mixing.SQL,
        "op7_chat_format": chat.SQL,
        "op8_vector_dedup": vector_dup.SQL,
        "op9_sharding": sharding.SQL,
        "op10_url_filter": url_filter.SQL,
    }
