"""A corpus pipeline over documents: language ID, near-dedup, mixing, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir). All stages but
the last return the columns that documents have; run() writes each stage's rows to the
shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import settle
from lodegraph.llm.langid import UNKNOWN, fit, identify, strangeness
from lodegraph.llm.mixing import label_weights, mix, repeated
from lodegraph.llm.near_dup import one_of_each
from lodegraph.llm.packing import pack

#: Bits by which a text must be beyond the bound: short texts have too little evidence against them to go.
EVIDENCE = 64.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages: those without a letter go, and those that are mostly of bytes no language has.

    The bound is half the bits a byte that the model itself gives to bytes it never saw, and EVIDENCE more in all, so short or
    unusual texts in letters that a language has stay. Where no row has a language, all with a letter stay.
    """
    model = fit(docs)
    found = identify(docs, model, keep=tuple(docs.columns), out=("_lang_pred", "_lang_score", "_lang_bits"))
    if not model["languages"]:
        return docs.where(F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)))
    bound = strangeness(model) / 2 + EVIDENCE / F.greatest(F.octet_length(F.col("text").cast("string")), F.lit(1))
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_bits") < bound)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return one_of_each(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3: a row for each time a document is taken; the one at a source's cut ends where its budget does."""
    weights = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return repeated(mix(docs, quality=weights, keep=tuple(docs.columns)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
