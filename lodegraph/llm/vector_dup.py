"""Near-duplicate embeddings: an exact metric range join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the join is one of a range. Each
vector is at home in the cell of its nearest pivot, and is copied into every cell of a
lower number whose border is within the range: a partner that lives there can be no farther, and
one in a cell of a higher number is copied here itself. So each pair meets in one cell, with one of
it at home there. Cells join independently, in blocks of bounded size. No pairs leave a block:
counts do, and a spanning forest of its links. Equal vectors are one class with a multiplicity.

More pivots make fewer comparisons and more copies. How many there are is chosen by the
cost of both, with the copies measured on a sample of vectors: where vectors lie in no
clusters (in many dimensions all borders are near), few pivots are the cheapest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.ann import matrix, one_for_each, usable
from lodegraph.llm.common import bounded_arrow, components, discard, let_go, settle

#: Pivots at most, rows at home in a cell at least that their number aims at, and rows of a block's either side.
MOST_PIVOTS, CELL, BLOCK = 1024, 256, 4096
#: What a copy costs, in comparisons; and rows that copies are measured on.
COPY, SAMPLE = 400, 1024
#: Added to the range, for rounding.
EDGE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(u: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of every copy: home cells, and cells of a lower number whose border is within reach."""
    near = u @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    # On unit vectors the distance to the plane between two pivots is the difference of cosines over their distance.
    gap, span = near[np.arange(len(u)), home][:, None] - near, apart[home]
    lower = np.arange(len(pivots))[None, :] <= home[:, None]
    row, cell = np.nonzero((gap <= (reach + EDGE) * span + EDGE) & lower)
    return row, cell, cell == home[row]


def pivots_for(sample: np.ndarray, rows: float, reach: float) -> np.ndarray:
    """Pivots for cells of about so many rows of one label, the first of the sample: as many as cost least in copies and comparisons."""
    best, least = sample[:1], np.inf
    n = 1
    while n <= min(MOST_PIVOTS, len(sample), max(1, rows / CELL)):
        pivots = np.unique(sample[:n], axis=0)
        _, cell, home = cells(sample[-SAMPLE:], pivots, reach)
        at_home, there = (np.bincount(c, minlength=len(pivots)) / min(len(sample), SAMPLE) for c in (cell[home], cell))
        cost = COPY * there.sum() + rows * (at_home * there).sum()
        if cost < least:
            best, least = pivots, cost
        n *= 2
    return best


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links (least id, id) that join whatever a block's links join."""
    out, open_ = [], links.any(axis=1)
    while open_.any():
        rows = np.zeros(len(left), bool)
        rows[open_.argmax()] = True
        front, cols = rows.copy(), np.zeros(len(right), bool)
        while front.any():
            new = links[front].any(axis=0) & ~cols
            cols |= new
            front = open_ & ~rows
            front[front] = links[front][:, new].any(axis=1)
            rows |= front
        ids = np.union1d(left[rows], right[cols])
        out += [(int(ids[0]), int(i)) for i in ids[1:]]
        open_ &= ~rows
    return out


def _joined(least: float, width: int):
    """The join of a block's vectors at home with its others: (a, n, None) for a vector with n partners there, (a, 0, b) for the forest of the links."""

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            a, b = left.column("rep").to_numpy(), right.column("e_rep").to_numpy()
            u, v = (unit(matrix(t.column(c).combine_chunks(), width)) for t, c in ((left, "v"), (right, "e_v")))
            linked = (u @ v.T >= least) & (a[:, None] != b[None, :])
            copied = ~right.column("e_home").to_numpy(zero_copy_only=False)
            # A pair at home counts when either is on the left; a copy is on the right only.
            for ids, n in ((a, linked @ right.column("e_m").to_numpy()), (b[copied], left.column("m").to_numpy() @ linked[:, copied])):
                some = np.flatnonzero(n)
                out[0].extend(ids[some].tolist())
                out[1].extend(n[some].tolist())
                out[2].extend([None] * len(some))
            for x, y in forest(linked, a, b):
                out[0].append(x)
                out[1].append(0)
                out[2].append(y)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["a", "n", "b"])

    return join


def vector_duplicates(vectors: DataFrame, least: float = 0.98, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row.

    Vectors of one label are linked whose cosine, in double precision, is least or more;
    n_links counts a vector's partners, component_id is the least id reachable over links.
    Vectors null, empty, zero, or with null or non-finite components, of a null label, or of
    different lengths are linked with nothing. Rows that repeat an id are one vector, the least label's and of
    these the least that can be linked, and each has its numbers. A null id's row has no links, no component and isn't kept. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_arrow(spark)
    ids = vectors.select(vectors[id_col].cast("bigint").alias("vec"))
    labelled = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vec_col].alias("_v"), vectors[label_col].cast("string").alias("label"))
    rows = usable(labelled.withColumn("_both", F.struct("id", "label")), "_both", "_v").select("id.id", "id.label", "v").where("id is not null and label is not null")
    rows = one_for_each(settle(rows, "vector-rows"))
    vector = rows.schema["v"].dataType.simpleString()
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1)))
    classes = settle(rows.groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")), "vector-classes")
    sizes = classes.groupBy("label", F.size("v").alias("w")).agg(F.count("*").alias("n")).groupBy("w").agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("n")).collect()
    reach = float(np.sqrt(2 - 2 * least))
    counted = spark.createDataFrame([], "rep bigint, n bigint")
    links, spent = spark.createDataFrame([], "a bigint, b bigint"), []
    for width, squares, total in sizes:  # rows of one length compare with each other
        part = classes.where(F.size("v") == width)
        drawn = part.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(MOST_PIVOTS + SAMPLE).select("v").toArrow()
        # Rows of the label that a row has, on the mean over rows: a large label counts by its rows.
        pivots = spark.sparkContext.broadcast(pivots_for(unit(matrix(drawn.column("v").combine_chunks(), width)), squares / total, reach))

        def copies(batches: Iterator[pa.RecordBatch], width: int = width, pivots=pivots) -> Iterator[pa.RecordBatch]:
            let_go()
            for b in batches:
                row, cell, home = cells(unit(matrix(b.column(3), width)), pivots.value, reach)
                taken = b.take(pa.array(row))
                yield pa.record_batch([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home)], ["rep", "label", "m", "v", "cell", "home"])

        spread = part.select("rep", "label", "m", "v").mapInArrow(copies, f"rep bigint, label string, m bigint, v {vector}, cell int, home boolean")
        spread = settle(spread, "vector-cells")
        blocks = (F.expr(f"cast(ceil(count_if(home) / {BLOCK}) as int)").alias("hn"), F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("an"))
        counts = spread.groupBy("label", "cell").agg(*blocks).where("hn > 0")
        placed = spread.join(counts, ["label", "cell"]).withColumn("hc", F.pmod(F.xxhash64("rep"), F.col("hn")).cast("int")).withColumn("ac", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("an")).cast("int"))
        homes = placed.where("home").withColumn("ac", F.explode(F.sequence(F.lit(0), F.col("an") - 1)))
        every = placed.withColumn("hc", F.explode(F.sequence(F.lit(0), F.col("hn") - 1))).select("rep", "m", "v", "home", "label", "cell", "hc", "ac")

        by = ["label", "cell", "hc", "ac"]
        right = every.toDF(*(f"e_{c}" for c in every.columns)).groupBy(*(f"e_{c}" for c in by))
        found = homes.select("rep", "m", "v", *by).groupBy(*by).cogroup(right).applyInArrow(_joined(least, width), "a bigint, n bigint, b bigint")
        found = settle(found, "vector-found")
        spent.append(spread)
        counted = counted.unionByName(found.where("b is null").select(F.col("a").alias("rep"), "n"))
        links = links.unionByName(found.where("b is not null").select("a", "b"))
    joined = components(links, "a", "b")
    discard(*spent)
    counted = counted.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.join(counted, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    known = rows.select("id", "label", "k1", "k2").join(named, ["label", "k1", "k2"]).select("id", "n_links", "c")
    out = ids.join(known, F.col("vec") == F.col("id"), "left")
    component = F.coalesce("c", "vec")
    kept = F.coalesce(F.col("vec") == component, F.lit(False))
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT DISTINCT vec_id AS node, vec_id AS got FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.got),
least AS (SELECT node, min(got) AS component_id FROM reach GROUP BY node)
SELECT node AS vec_id, (SELECT count(*) FROM links l WHERE l.a = node)::BIGINT AS n_links, component_id, node = component_id AS kept FROM least
"""
