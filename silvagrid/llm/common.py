"""Shared pieces of the training-data operators: table access, tables written to the
shared folder, and connected components over links that are never collected."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.sources.shared import dropped, gathered, saved, shared_dir  # noqa: F401

#: Kernels work on slices of an Arrow batch that hold about so many bytes of text.
SLICE_BYTES = 4 << 20
#: A side of a join is broadcast only if it has at most so many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_small(left: DataFrame, right: DataFrame, on: list[str] | str, how: str, rows: int) -> DataFrame:
    """Join; the right side, of so many counted rows, is broadcast only within BROADCAST_ROWS. Beyond that
    both sides are shuffled (adaptive execution splits what is skewed)."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


@contextmanager
def small_batches(spark: SparkSession, most: int = SLICE_BYTES) -> Iterator[None]:
    """Plans made here hand Python Arrow batches of about ``most`` bytes (a longer row stands alone) instead of 10,000
    rows or 64 MB, which each task holds several times, outside the heap and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text or binary column with about ``most`` bytes each (a longer row stands alone)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end (null: empty), and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, offs, data = filled.buffers()
    offsets = np.frombuffer(offs, np.int64, len(filled) + 1 + filled.offset)[filled.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def components(links: DataFrame, most_rounds: int = 60, write: Callable[..., DataFrame] = saved) -> DataFrame:
    """Connected components of links (u, v), as rows (id, component) for every id that has a link to another;
    component is the smallest id reachable.

    Alternating star contraction: each round sends every node's larger neighbours (then its smaller ones) to
    its smallest neighbour. Rows stay on the executors, one written table per round; the number of rounds
    grows with the logarithm of the longest chain. Minima are aggregated on the map side, so one node with
    very many links adds one row per task; its links are joined to that minimum by a join that adaptive
    execution can split. ``write`` (saved or gathered) writes the tables.
    """
    spark = links.sparkSession
    now = write(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "u", "v")
    for _ in range(most_rounds):
        # done when every node hangs on one other, which hangs on none
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h")).where("n > 1 OR (n = 1 AND h = 1)").isEmpty():
            break
        # large star: a node's neighbours that are larger than it go to its smallest neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = write(small, "u", "v")
        dropped(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
