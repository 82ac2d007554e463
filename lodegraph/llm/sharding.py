"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (documents of equal text) stand in the order of a digest and are never cut.
The smallest shard capacity that a greedy walk along the groups can meet is found by
binary search. Under that capacity each cut has a latest place, where such walks from the first
group come to, and an earliest one, where a walk from the last group comes to; between the two
the shards are cut as near to equal sizes as groups allow, so the last one isn't left short.

The walk runs on the driver, over a bounded table: digests fall into ranges, and only
ranges in which a cut may fall are split again, until those are single groups. The
positions a cut can take are bounded by the capacity's bounds, so the walk sees
single groups wherever it matters, at any number of groups. A group larger than a
fair share gets a shard of its own beforehand, out of the order; there are fewer of those than shards,
and no partition has less in its largest shard than such a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.llm.common import settle

#: Bits of a group's digest, and of the first ranges.
KEY_BITS, FIRST_BITS = 60, 14
#: Rows of ranges that the driver asks for at a time.
MOST_RANGES = 1 << 17
#: Cells of a shard in which slots are counted.
CELLS = 1024


@dataclass
class Cuts:
    """First digest of each shard in order, and the digests that have a shard of their own."""

    starts: list[int]
    alone: list[int]
    capacity: int


def walk(bytes_: np.ndarray, capacity: int) -> list[int]:
    """First range of each shard of a greedy walk."""
    ends = np.cumsum(bytes_)
    starts, at, done = [], 0, 0
    while at < len(bytes_):
        starts.append(at)
        nxt = int(np.searchsorted(ends, done + capacity, side="right"))
        at = max(nxt, at + 1)
        done = int(ends[at - 1])
    return starts


def even(bytes_: np.ndarray, capacity: int, shards: int) -> list[int]:
    """First range of each shard: none above the capacity, which must be feasible, and cuts as near to equal sizes as that allows."""
    n, ends = len(bytes_), np.cumsum(bytes_)
    begins = ends - bytes_
    earliest, at = [0] * (shards + 1), n
    for j in range(shards - 1, 0, -1):
        at = int(np.searchsorted(begins, ends[at - 1] - capacity)) if at else 0
        earliest[j] = at
    starts = [0]
    for j in range(1, shards):
        goal = int(ends[-1]) * j / shards
        near = int(np.searchsorted(ends, goal))
        if near < n and ends[near] - goal <= goal - begins[near]:
            near += 1
        latest = int(np.searchsorted(ends, begins[starts[-1]] + capacity, side="right"))
        cut = min(max(near, earliest[j], starts[-1] + 1), latest)
        if cut >= n:
            break
        starts.append(cut)
    return starts


def least_capacity(bytes_: np.ndarray, shards: int) -> int:
    """The smallest capacity with which the greedy walk needs no more than so many shards."""
    low, high = max(-(-int(bytes_.sum()) // shards), int(bytes_.max())), int(bytes_.sum())
    while low < high:
        mid = (low + high) // 2
        if len(walk(bytes_, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _ranges(groups: DataFrame, shift: int, within: list[int] | None = None, parent_shift: int = 0) -> np.ndarray:
    """(first digest, bytes, groups) of each range of 2^shift digests, in order; only those within the named parent ranges."""
    if within is not None:
        named = groups.sparkSession.createDataFrame([(i,) for i in within], "parent bigint")
        groups = groups.join(F.broadcast(named), F.shiftright("group", parent_shift) == F.col("parent"), "left_semi")
    rows = groups.groupBy(F.shiftright("group", shift).alias("r")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).toPandas()
    rows = rows.sort_values("r")
    return np.stack([rows.r.to_numpy(np.int64) << shift, rows.b.to_numpy(np.int64), rows.n.to_numpy(np.int64)])


def cuts(groups: DataFrame, shards: int) -> Cuts:
    """Cuts of (group, bytes) rows, one for each group, group a digest of KEY_BITS bits."""
    largest = [(r.group, r.bytes) for r in groups.orderBy(F.desc("bytes"), "group").limit(shards).collect()]
    if not largest:
        return Cuts([], [], 0)
    rest = groups.agg(F.sum("bytes")).first()[0]
    alone: list[int] = []
    for group, size in largest:
        if len(alone) == shards - 1 or size * (shards - len(alone)) <= rest:
            break
        alone.append(group)
        rest -= size
    left = shards - len(alone)
    if alone:
        groups = groups.where(~F.col("group").isin(alone))
    shift = KEY_BITS - FIRST_BITS
    table = _ranges(groups, shift)
    if not table.shape[1]:
        return Cuts([], alone, max(s for _, s in largest))
    most = next((s for g, s in largest if g not in alone), int(table[1].max()))
    while True:
        first, size, count = table
        high, total = least_capacity(size, left), int(size.sum())
        low = max(-(-total // left), most)
        ends = np.cumsum(size)
        begins = ends - size
        may = np.zeros(len(size), bool)
        for j in range(1, left):  # where the j-th cut can be, for any capacity from low to high
            a, b = max(j * (low - most), total - (left - j) * high), min(j * high, total)
            may |= (ends > a) & (begins < b)
        may &= count > 1
        if shift == 0 or not may.any():
            break
        bits = min(shift, max(1, int(np.log2(MOST_RANGES / may.sum()))) if may.sum() < MOST_RANGES else 1)
        parts = _ranges(groups, shift - bits, [int(x) >> shift for x in first[may]], shift)
        table = np.concatenate([table[:, ~may], parts], axis=1)
        table = table[:, np.argsort(table[0], kind="stable")]
        shift -= bits
    capacity = least_capacity(table[1], left)
    return Cuts([int(table[0][i]) for i in even(table[1], capacity, left)], alone, capacity)


def _digest(text: Column, bits: int) -> Column:
    """The first bits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint")


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row; equal texts share a shard, sizes are near equal.

    size is the text's UTF-8 bytes and the overhead; slot runs from 0 in its shard without
    gaps. A null text has 0 bytes and no crc32, and is a group of its own for each id; empty
    texts are equal texts. Repeated rows have a slot each. With fewer groups than shards some
    shards stay empty; an empty table gives an empty result. Other columns are not read.
    """
    text, key = docs[text_col].cast("string"), docs[id_col]
    named = F.coalesce(F.concat(F.lit("t"), text), F.concat(F.lit("n"), F.coalesce(key.cast("string"), F.lit(""))))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead
    rows = docs.select(key.alias("id"), size.alias("size"), F.crc32(text).alias("crc"), _digest(named, KEY_BITS).alias("group"))
    rows = settle(rows, "shard-rows")
    found = cuts(settle(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups"), shards)
    place = F.lit(-1)
    for start in found.starts:
        place = place + (F.col("group") >= start).cast("int")
    for k, group in enumerate(found.alone):
        place = F.when(F.col("group") == group, len(found.starts) + k).otherwise(place)
    rows = rows.withColumn("shard", place.cast("int"))
    rows = rows.withColumn("cell", (_digest(F.concat_ws(" ", "id", "size"), 32) % CELLS).cast("int"))
    # A shard's slots are counted cell by cell, so no shard is sorted in one task.
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "cell").orderBy("id", "group")
    rows = rows.withColumn("in_cell", F.row_number().over(inside).cast("bigint") - 1).join(F.broadcast(first), ["shard", "cell"])  # at most shards * CELLS rows
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("in_cell")).alias("slot"))


#: The same cuts of 40 shards, over single groups.
SQL = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, text,
    ('0x' || substr(md5(coalesce('t' || text, 'n' || coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS place FROM documents),
-- crc32 byte by byte, over the table of its 256 remainders.
rounds AS (
  SELECT v, v AS c, 0 AS k FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8),
remainders AS MATERIALIZED (SELECT list(c ORDER BY v) AS t FROM rounds WHERE k = 8),
summed AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM (SELECT DISTINCT text FROM sized WHERE text IS NOT NULL), remainders),
grouped AS MATERIALIZED (SELECT place, sum(size)::BIGINT AS bytes FROM sized GROUP BY place),
ranked AS (
  SELECT place, bytes, row_number() OVER by_size - 1 AS k, sum(bytes) OVER () AS total, sum(bytes) OVER by_size - bytes AS before FROM grouped
  WINDOW by_size AS (ORDER BY bytes DESC, place ROWS UNBOUNDED PRECEDING)),
alone AS MATERIALIZED (
  SELECT place, k FROM (SELECT place, k, bool_and(k < 39 AND bytes * (40 - k) > total - before) OVER (ORDER BY k) AS apart FROM ranked) WHERE apart),
ends AS MATERIALIZED (
  SELECT place, bytes, e - bytes AS b, e FROM (
    SELECT place, bytes, (sum(bytes) OVER (ORDER BY place))::BIGINT AS e FROM grouped WHERE place NOT IN (SELECT place FROM alone))),
bound AS MATERIALIZED (SELECT max(e) AS total, max(bytes) AS most, 40 - (SELECT count(*) FROM alone) AS parts FROM ends),
-- Binary search; each row is one shard of a greedy walk under the middle capacity.
search AS (
  SELECT greatest((total + parts - 1) // parts, most) AS low, total AS high, 0::BIGINT AS done, 0::BIGINT AS used FROM bound
  UNION ALL
  SELECT CASE WHEN done < total AND used = parts THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN done = total THEN (low + high) // 2 ELSE high END,
    CASE WHEN done = total OR used = parts THEN 0 ELSE (SELECT max(e) FROM ends WHERE e <= done + (low + high) // 2) END,
    CASE WHEN done = total OR used = parts THEN 0 ELSE used + 1 END
  FROM search, bound WHERE low < high),
least AS MATERIALIZED (SELECT low AS capacity FROM search WHERE low >= high),
-- The earliest begin of each shard, from the last one back, and the one nearest to equal sizes.
earliest AS (
  SELECT parts AS j, total AS p FROM bound UNION ALL
  SELECT j - 1, coalesce((SELECT max(e) FROM ends WHERE b < p - capacity), 0) FROM earliest, least WHERE j > 1),
goals AS (SELECT j, total * j / parts AS goal FROM bound, range(1, 40) t(j) WHERE j < parts),
nearest AS (
  SELECT j, CASE WHEN min(e) - goal <= goal - min(b) THEN min(e) ELSE min(b) END AS p FROM goals JOIN ends ON e >= goal GROUP BY j, goal),
starts AS (
  SELECT 0::BIGINT AS j, 0::BIGINT AS p UNION ALL
  SELECT s.j + 1, least(greatest(n.p, f.p, (SELECT min(e) FROM ends WHERE e > s.p)), (SELECT max(e) FROM ends WHERE e <= s.p + capacity))
  FROM starts s JOIN nearest n ON n.j = s.j + 1 JOIN earliest f ON f.j = s.j + 1, least, bound WHERE s.p < total),
kept AS MATERIALIZED (SELECT j, p FROM starts, bound WHERE p < total),
placed AS MATERIALIZED (
  SELECT place, max(j) AS shard FROM ends JOIN kept ON p <= b GROUP BY place
  UNION ALL SELECT place, (SELECT count(*) FROM kept) + k FROM alone)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, place) - 1 AS slot, NULL::INT AS grown_shard
FROM (SELECT *, ('0x' || substr(md5(concat_ws(' ', doc_id, size)), 1, 8))::BIGINT % 1024 AS cell FROM sized) JOIN placed USING (place) LEFT JOIN summed USING (text)
"""
