"""Graphs from text files: triples, interactions and attribute tables.

Ids follow first appearance, over triples, then interactions, then attribute files.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.graph import TYPE_SHIFT, Graph, indexed
from lodegraph.sources.shared import reachable

#: The relation of an interaction file.
INTERACTION = "has_interact"


#: Numbers as nearly all files write them; other spellings that Python reads are read by it.
PLAIN_WHOLE = r"^[+-]?[0-9]{1,18}$"
PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _lines(spark: SparkSession, path: str, source: int) -> DataFrame:
    """(source, line, f: fields); lines compare by their order in the file: by split, then within it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    line = F.struct("file", "split", F.monotonically_increasing_id().alias("row"))
    return rows.select(F.lit(source).alias("source"), line.alias("line"), F.split("value", "\t", -1).alias("f"))


def _read(parse, value: str):
    """What parse makes of the text, or None."""
    try:
        parsed = parse(value)
    except ValueError:
        return None
    return None if isinstance(parsed, int) and not -(1 << 63) <= parsed < 1 << 63 else parsed


def _by_python(parse):
    """Values in spellings that only Python reads, in one that Spark reads too; plain ones are handed over as nulls."""

    def read(values: pd.Series) -> pd.Series:
        parsed = [None if v is None else _read(parse, v) for v in values]
        return pd.Series([None if v is None else str(v) for v in parsed], dtype=object)

    return F.pandas_udf(read, "string")


def _typed(df: DataFrame, names: list[str]) -> DataFrame:
    """Each text column as the narrowest of whole numbers, numbers and text that reads all its values (whole numbers beyond 64 bits are numbers).

    One aggregate counts odd spellings; only a column that has some goes through Python, and only with those.
    """
    if not names:
        return df
    ways = ((PLAIN_WHOLE, int, "bigint"), (PLAIN_NUMBER, float, "double"))
    counts = [F.count_if(~F.col(f"`{n}`").rlike(pattern)).alias(f"c{i}_{k}") for i, n in enumerate(names) for k, (pattern, _, _) in enumerate(ways)]
    odd, made = df.agg(*counts).first(), {}
    for i, n in enumerate(names):
        column = F.col(f"`{n}`")
        for k, (pattern, parse, kind) in enumerate(ways):
            plain = F.when(column.rlike(pattern), column.try_cast(kind))
            if not odd[f"c{i}_{k}"]:
                made[n] = plain
                break
            by_python = _by_python(parse)(F.when(~column.rlike(pattern), column)).try_cast(kind)
            # A few odd values that all read are a column's empty cells or other spellings; one that doesn't settles it.
            if df.where(column.isNotNull() & ~column.rlike(pattern)).where(by_python.isNull()).isEmpty():
                made[n] = F.coalesce(plain, by_python)
                break
    return df.withColumns(made)


def from_files(spark: SparkSession, kg: str | None = None, ui: str | None = None, attrs: list[str] = (), sf: tuple[float, float] | None = None, labels: dict[str, str] | None = None) -> Graph:
    """A graph from files of tab-separated text.

    kg: head, relation, tail; shorter lines go, further fields are ignored. ui: user, item and
    an optional rating; sf keeps ratings from its first to its second number, and then drops
    lines without one. attrs: files named <anything>.<type>, with a header, the id first;
    short rows and empty cells are nulls, an id's last row counts, and a second file of a
    type adds its columns by id. Nodes that only an attribute file names are in the graph.
    """
    reachable(spark)
    keys, edges = [], None
    if kg is not None:
        triples = _lines(spark, kg, 0).where(F.size("f") >= 3).select("source", "line", F.col("f")[0].alias("h"), F.col("f")[1].alias("r"), F.col("f")[2].alias("t"))
        edges = triples
    if ui is not None:
        pairs = _lines(spark, ui, 1).where(F.size("f") >= 2)
        if sf is not None:
            pairs = pairs.where(F.size("f") >= 3).where(F.col("f")[2].cast("double").between(*sf))
        pairs = pairs.select("source", "line", F.col("f")[0].alias("h"), F.lit(INTERACTION).alias("r"), F.col("f")[1].alias("t"))
        edges = pairs if edges is None else edges.unionByName(pairs)
    if edges is not None:
        edges = edges.cache()
        for end, part in (("h", 0), ("t", 1)):
            keys.append(edges.select("source", "line", F.lit(part).alias("part"), F.col(end).alias("key")))
    columns: dict[str, DataFrame] = {}
    for k, path in enumerate(attrs):
        type_ = path.rsplit(".", 1)[1]
        rows = _lines(spark, path, 2 + k)
        top = rows.orderBy("line").first()
        names = top.f[1:]
        cells = [F.when(F.get("f", F.lit(i + 1)) != "", F.get("f", F.lit(i + 1))).alias(n) for i, n in enumerate(names)]
        first_line = F.struct(*(F.lit(v).alias(k) for k, v in top.line.asDict().items()))
        rows = rows.where(F.col("line") > first_line).where(F.col("f")[0] != "")
        keys.append(rows.select("source", "line", F.lit(0).alias("part"), F.concat(F.lit(f"{type_}."), F.col("f")[0]).alias("key")))
        last = rows.select(F.col("f")[0].alias("raw"), F.struct("line", *cells).alias("row")).groupBy("raw").agg(F.max_by("row", "row.line").alias("row"))
        table = last.select("raw", *(F.col(f"row.`{n}`").alias(n) for n in names))
        columns[type_] = table if type_ not in columns else columns[type_].join(table.select("raw", *(n for n in names if n not in columns[type_].columns)), "raw", "full")
    if not keys:
        return Graph(spark, [], [], {}, {}, labels or {}, True)
    seen = keys[0]
    for k in keys[1:]:
        seen = seen.unionByName(k)
    first = seen.groupBy("key").agg(F.min(F.struct("source", "line", "part")).alias("at"))
    first = first.select("at", F.split("key", r"\.", 2)[0].alias("type"), F.get(F.split("key", r"\.", 2), F.lit(1)).alias("raw"), "key").cache()
    types = [r.type for r in first.groupBy("type").agg(F.min("at").alias("at")).orderBy("at").collect()]
    nodes, tables = None, {}
    for i, type_ in enumerate(types):
        block = indexed(first.where(F.col("type") == type_).select("at", "key", "raw"), ["at"], "place")
        block = block.select((F.lit(i << TYPE_SHIFT) + F.col("place")).alias("nid"), "key", "raw").cache()
        nodes = block if nodes is None else nodes.unionByName(block)
        table = block.select("nid", F.col("raw").alias("id"), "raw")
        if type_ in columns:
            table = table.join(columns[type_], "raw", "left")
        table = table.drop("raw")
        tables[type_] = _typed(table, [c for c in table.columns if c != "nid"]).cache()
    relations, parts = [], {}
    if edges is not None:
        relations = [r.r for r in edges.groupBy("r").agg(F.min(F.struct("source", "line")).alias("at")).orderBy("at").collect()]
        ends = nodes.select("key", "nid")
        joined = edges.join(ends.withColumnsRenamed({"key": "h", "nid": "src"}), "h").join(ends.withColumnsRenamed({"key": "t", "nid": "dst"}), "t").select("r", "src", "dst").cache()
        parts = {r: [(None, None, joined.where(F.col("r") == r).select("src", "dst"))] for r in relations}
    return Graph(spark, types, relations, tables, parts, dict(labels or {}), True)
