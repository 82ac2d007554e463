"""What several operators share: bounded Arrow batches, what a Python worker keeps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.shared import reachable, settle

#: An Arrow batch handed to Python holds at most this many bytes (and at least one row).
BATCH_BYTES = 8 << 20
#: Bytes that an operator's cache takes in a Python worker at most; what an operator must hold (a model, a vocabulary) comes on top.
CACHE_BYTES = 32 << 20

#: What this Python worker keeps between tasks: of one operator only, so that a worker that serves several never holds the sum.
_HELD: list[tuple] = []


def held(key: tuple, build: Callable[[], object]):
    """What build makes, kept until another key is asked for."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        _HELD.append((key, build()))
    return _HELD[0][1]


def let_go() -> None:
    """Give back what another operator left in this worker."""
    _HELD.clear()


_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
#: An odd base and its inverse modulo 2^64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are cut into words at a time (more where a single word is longer).
PART = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on arrays."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(GOLDEN))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_KEPT_POWERS = _powers(PART + 1)


def bytes_of(*values: int) -> np.ndarray:
    """A table of the bytes that words stand between."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


def hashed_words(raw: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word between the bytes of apart: a polynomial of its bytes, from one pass of prefix sums."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], apart[raw], [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _KEPT_POWERS if len(raw) <= PART else _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def parts(raw: bytes, apart: np.ndarray, size: int = PART) -> Iterator[bytes]:
    """A text in parts of at most so many bytes, cut behind bytes of apart; longer only where a word is."""
    at = 0
    while len(raw) - at > size:
        window = np.flatnonzero(apart[np.frombuffer(raw, np.uint8, size, at)])
        if len(window):
            end = at + int(window[-1]) + 1
        else:
            end = next((k + 1 for k in range(at + size, len(raw)) if apart[raw[k]]), len(raw))
        yield raw[at:end]
        at = end
    if at < len(raw):
        yield raw[at:]


def bounded_arrow(spark: SparkSession) -> None:
    """Bound the batches Spark hands to Python by bytes, for texts may be long; let workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    reachable(spark)


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that no result reads any more."""
    for df in settled:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM see which plans nobody holds any more: its cleaner then deletes their shuffles from the executors' disks."""
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of undirected links: (node, component), the smallest reachable node.

    Alternating large-star and small-star steps; every step halves paths, and is
    written to the shared folder. Links of stars, as here, settle in two or three.
    Nodes without links don't appear. Null ends are ignored.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    edges, sign = settle(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(down, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = settle(small, "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if now == sign:
            break
        sign = now
    up = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return up.unionByName(up.select(F.col("component").alias("node"), "component").distinct())
