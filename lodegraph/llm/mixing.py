"""Mixing sources to target weights: Efraimidis-Spirakis sampling within each source.

Every document draws an exponential key, scaled by its quality weight; within a
source, documents come by key. A source's budget first takes whole epochs, then as
many documents of the next one, by key, as its prefix sums of sizes allow; the
document at the budget's end gives the words that are left. Draws are a hash of the
document's id, so reruns agree.

A source isn't sorted in one place: keys fall into ranges, sizes are summed for each
range, and only the range in which the budget ends is sorted. What is kept of a
source is its cut, one row; whether a document is taken then follows from its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import settle

#: Ranges of keys of one source.
RANGES = 4096
#: Sources whose cuts (one row each) are broadcast; those of more sources are joined, each copied to SALTS parts of its source's rows.
MOST_BROADCAST, SALTS = 50_000, 64
#: What words are made of: no space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def exponential_key(key: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a digest of seed and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("bigint")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def targets(sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """(source, source_size, target): the sum of sizes shared by weights that repeat along the sources
    by code point (null last); no target above cap times its source, the excess shared again by weight.

    sources has one row for each source, and as few go through single-task windows here.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(c)) for c in cycle)), F.pmod(F.row_number().over(named) - 1, F.lit(len(cycle))) + 1))
    weighed = weighed.withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rate = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # Sources stand by how soon they fill: the rate at the first that stays below its top holds for all behind it.
    rated = weighed.withColumn("rate", rate).withColumn("rate", F.min(F.when(F.col("ratio") > F.col("rate"), F.struct("ratio", "rate"))).over(everything)["rate"])
    return rated.select("source", "source_size", F.least("top", F.coalesce(F.col("rate") * F.col("weight"), F.col("top"))).alias("target"))


def _plan(rows: DataFrame, cycle: tuple[float, ...], cap: float) -> DataFrame:
    """One row for each source: its sizes, epochs and cut. rows: source, size, key, id_key, range."""
    by_range = settle(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), "mix-ranges")
    goal = targets(by_range.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, cap)
    goal = goal.withColumn("words", F.round("target").cast("bigint")).withColumn("epochs", F.expr("if(source_size > 0, words div source_size, 0)"))
    goal = settle(goal.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")), "mix-sources")
    along = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = by_range.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).alias("a").join(goal.alias("g"), F.expr("a.source <=> g.source"))
    ends = ends.where("before <= rest and rest < before + size").select("a.source", "range", (F.col("rest") - F.col("before")).alias("rest"))
    last = rows.alias("r").join(ends.alias("e"), F.expr("r.source <=> e.source and r.range = e.range"))
    last = last.groupBy("r.source", "key", "id_key", "e.rest").agg(F.sum("r.size").alias("size"))
    order = W.partitionBy("source").orderBy("key", "id_key").rowsBetween(W.unboundedPreceding, -1)
    cut = last.withColumn("left", F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0))).where("left >= 0 and left < size")
    cut = cut.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.col("id_key").alias("cut_id"), F.col("left").alias("cut_left"), F.col("size").alias("cut_size"))
    return goal.join(cut, F.expr("source <=> cut_source"), "left").drop("cut_source")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: DataFrame | None = None,
    cycle: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: str = "mix", keep: tuple[str, ...] = (),
) -> DataFrame:
    """For every row: (id_col, size, source_size, target, taken), and the columns named in keep.

    size is the number of words, taken how many words the mix takes of the row, repeats
    counted: whole epochs of it, and all or nothing of one more, but for the row in which
    its source's budget ends. quality: (id_col, weight), weights above 0, at most one row for
    an id; documents without one weigh 1. Null texts have size 0; null sources are one
    source; rows that repeat an id draw one key and share what is left at the cut by
    size. An empty table gives an empty result.
    """
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), *(docs[c].alias(f"_keep_{c}") for c in keep))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        weights = quality.select(quality[id_col].alias("_qid"), quality["weight"].cast("double").alias("weight"))
        rows = rows.join(weights, F.col("_id") == F.col("_qid"), "left").drop("_qid").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = rows.withColumn("id_key", key).withColumn("key", exponential_key(F.col("id_key"), F.col("weight"), seed))
    rows = rows.withColumn("range", F.floor(F.lit(RANGES) * (1 - F.exp(-F.col("key")))).cast("int")).drop("weight")
    # Sources are few and one may have most rows: cuts are found from slim rows, and meet the rows where those are.
    slim = settle(rows if not keep else rows.select("source", "size", "key", "id_key", "range"), "mix-rows")
    if not keep:
        rows = slim
    plan = settle(_plan(slim.select("source", "size", "key", "id_key", "range"), cycle, cap).withColumnRenamed("source", "plan_source"), "mix-cuts")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    if plan.count() <= MOST_BROADCAST:
        taken = rows.join(F.broadcast(plan), same)
    else:
        salted = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        taken = rows.withColumn("salt", F.pmod(F.xxhash64("id_key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("plan_salt")))
    behind = F.expr("key > cut_key or (key = cut_key and id_key > cut_id)")
    at_cut = F.expr("key = cut_key and id_key = cut_id")
    part = F.when(F.col("cut_key").isNull(), F.lit(0)).when(at_cut, F.expr("size * cut_left div cut_size")).when(behind, F.lit(0)).otherwise(F.col("size"))
    count = (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken")
    return taken.select(F.col("_id").alias(id_col), "size", "source_size", "target", count, *(F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col))


def repeated(mixed: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mix as documents: a row for each time it takes a document, the last one cut to the words taken.

    Documents without words are none of the mix's words, and go.
    """
    times = mixed.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.expr("cast(ceil(taken / size) as int)"))))
    left = F.expr("least(taken - (_copy - 1) * size, size)")
    # The first words, each with the white space behind it; only at a source's cut.
    cut = F.expr(rf"array_join(slice(regexp_extract_all({text_col}, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), 1, cast(_left as int)), '')")
    cut_rows = times.withColumn("_left", left).withColumn(text_col, F.when(F.col("_left") < F.col("size"), cut).otherwise(F.col(text_col)))
    return cut_rows.select(*columns)


#: Weights of a document that labels call good or bad.
GOOD, BAD = 2.0, 0.5


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels; of several labels of a document the best counts."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, BAD).otherwise(1.0).alias("weight"))


SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN b.q = 1 THEN 2.0::DOUBLE WHEN b.q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM sources),
rated AS (SELECT *, top / weight AS ratio,
    ((SELECT sum(source_size)::DOUBLE FROM sources) - coalesce(sum(top) OVER w, 0::DOUBLE)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0::DOUBLE)) AS rate
  FROM weighed WINDOW w AS (ORDER BY top / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(top, coalesce((SELECT arg_min(rate, ratio) FROM rated WHERE ratio > rate) * weight, top)) AS target FROM rated),
parts AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goal),
lined AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.words - p.epochs * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken FROM lined
"""
