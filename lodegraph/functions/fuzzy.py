"""Graded membership: how close texts are, and how membership fades with distance."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def closeness(needle: str, text: str) -> float:
    """1 where the needle is part of the text, else the ratio of their matching blocks; an empty needle is part of nothing. Both in lower case."""
    return 1.0 if needle and needle in text else SequenceMatcher(None, needle, text).ratio()


def closest(values: DataFrame, needles: list[str], k: int, cutoff: float, measure=closeness) -> DataFrame:
    """(nid): of values (nid, text), the k closest to each needle.

    Where k values contain the needle, the first k of those by id; else the k of
    greatest closeness, the larger id first among equals, as far as they reach the
    cutoff. Containment is native; the measure runs on distinct texts of needles that
    containment doesn't fill.
    """
    spark = values.sparkSession
    asked = [n for n in dict.fromkeys(str(n).lower() for n in needles) if n]
    if not asked:
        return spark.createDataFrame([], "nid bigint")
    wanted = F.broadcast(spark.createDataFrame([(n,) for n in asked], "needle string"))  # as many as the caller named
    texts = values.where(F.col("text").isNotNull()).select("nid", F.lower(F.col("text").cast("string")).alias("text"))
    inside = texts.join(wanted, F.contains("text", "needle"))
    rank = W.partitionBy("needle").orderBy("nid")
    inside = inside.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("needle", "nid")
    filled = {r.needle for r in inside.groupBy("needle").count().where(F.col("count") >= k).collect()}
    full = inside.where(F.col("needle").isin(sorted(filled))).select("nid") if filled else spark.createDataFrame([], "nid bigint")
    rest = [n for n in asked if n not in filled]
    if not rest:
        return full.distinct()

    def score(texts_: pd.Series) -> pd.Series:
        return texts_.map(lambda t: [float(measure(n, t)) for n in rest])

    # A ratio is twice the characters in common over all: texts too unlike in length can't reach the cutoff.
    size = F.length("text")
    able = [F.lit(2.0) * F.least(size, F.lit(len(n))) >= F.lit(float(cutoff)) * (size + F.lit(len(n))) for n in rest]
    distinct = texts.select("text").distinct()
    if measure is closeness:
        distinct = distinct.where(reduce(lambda a, b: a | b, [*able, *(F.contains("text", F.lit(n)) for n in rest)]))
    scored = distinct.withColumn("m", F.pandas_udf(score, "array<double>")("text"))
    scored = scored.select("text", F.posexplode("m").alias("needle", "m")).where(F.col("m") >= cutoff)
    best = W.partitionBy("needle").orderBy(F.desc("m"), F.desc("nid"))
    near = texts.join(scored, "text").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return full.unionByName(near.select("nid")).distinct()


def similarity(text: Column, needles: list[str]) -> Column:
    """The greatest closeness to any needle; 0 for a null text."""
    asked = [str(n).lower() for n in needles]
    real = [n for n in asked if n]
    part = F.lit(False)
    for n in real:
        part = part | F.contains(text, F.lit(n))

    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0.0 if t is None else max((closeness(n, t) for n in asked), default=0.0))

    # Rows that containment settles are handed to the measure as nulls.
    return F.when(text.isNull(), 0.0).when(part, 1.0).otherwise(F.pandas_udf(score, "double")(F.when(~part, text)))


def decay(distance: Column, sigma: float, mode: str) -> Column:
    r = distance / F.lit(float(sigma))
    bell = F.exp(F.lit(-0.5) * r * r)
    if mode == "linear":
        return F.greatest(F.lit(0.0), 1 - r / 3)
    if mode == "sigmoid":
        return 1 / (1 + F.exp(r - 3))
    if mode == "leaky":
        return F.greatest(F.lit(0.05) * F.greatest(F.lit(0.0), 1 - r / 6), bell)
    return bell
