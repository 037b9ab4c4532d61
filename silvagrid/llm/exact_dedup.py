"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its own bytes says so, so equal texts always give equal chunks. Chunks
are deduplicated to *verified* identifiers: among the chunks with one digest, all bytes are compared (the
smallest and the largest value must agree; were two contents ever to share a digest, longer digests are taken
until none do). After that, only ordered identifier lists ("recipes") are compared. The bytes of a chunk travel
once, after a combine on the map side, so a chunk repeated in very many documents adds one row per task.

Cases: a null text counts as empty; empty texts are equal to each other (the empty recipe). Ties: of equal
texts the row with the largest doc_id stays. Repeated rows each give a row and each count in group_size. A
null doc_id is compared as the smallest. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvagrid.llm.common import saved, slices, small_batches, table, text_bytes

#: Chunk sizes in bytes: none below LEAST but the last, none above MOST, about LEAST + 2**BITS on average.
LEAST, BITS, MOST = 512, 11, 16384
#: Bytes of text that are cut at a time: the hashes of each place take several times as much.
SLICE = 256 << 10
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(raw: np.ndarray, offsets: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each row: a gear hash over the 32 bytes before a place, by five doublings."""
    h = _GEAR[raw]
    width = 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, at = [], a
        if b - a > least:
            # the hash looks back 32 bytes; places nearer than ``least`` to a chunk's start are not used, so no
            # hash reaches into the row before
            for m in marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)].tolist():
                while m - at > most:
                    at += most
                    ends.append(at)
                if m - at >= least:
                    at = m
                    ends.append(at)
            while b - at > most:
                at += most
                ends.append(at)
        if at < b:
            ends.append(b)
        out.append(ends)
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size: int, carried: tuple[str, ...] = (), within: str | None = None):
    """``within``: the text is that field of the column ``row``, so that it comes once."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text") if within is None else batch.column("row").field(within)
            for a, b in slices(texts, SLICE):
                part = batch.slice(a, b - a)
                raw, offs = text_bytes(texts.slice(a, b - a))
                whole = raw.tobytes()
                ends = cut_points(raw, offs)
                recipes, shas = [], []
                for start, stop, cuts in zip(offs[:-1].tolist(), offs[1:].tolist(), ends, strict=True):
                    at, ids = start, []
                    for c in cuts:
                        ids.append(_digest(whole[at:c], size))
                        at = c
                    recipes.append(b"".join(ids))
                    shas.append(hashlib.sha256(whole[start:stop]).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(recipes, pa.binary()), pa.array(shas, pa.string()), *(part.column(c) for c in carried)], names=["doc_id", "recipe", "text_sha256", *carried])

    return run


def _chunks(size: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                raw, offs = text_bytes(batch.column("text").slice(a, b - a))
                whole, seen = raw.tobytes(), {}
                for start, cuts in zip(offs[:-1].tolist(), cut_points(raw, offs), strict=True):
                    at = start
                    for c in cuts:
                        chunk = whole[at:c]
                        seen.setdefault((_digest(chunk, size), chunk), None)
                        at = c
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([v for _, v in seen], pa.binary())], names=["digest", "chunk"])

    return run


def _telling(source: DataFrame, size: int) -> int:
    """The digest size, from ``size`` up, at which no two chunks of source's texts share a digest."""
    while True:
        chunks = source.select("text").mapInArrow(_chunks(size), "digest binary, chunk binary")
        # min and max keep one value per digest and task before anything is shuffled
        clashes = chunks.groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high")
        with small_batches(source.sparkSession):
            told = clashes.isEmpty()
        if told:
            return size
        if size >= 64:
            raise RuntimeError("two chunks share a digest of 64 bytes")
        size = min(64, 2 * size)


def exact_groups(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id", digest_bytes: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(doc_id).alias("row_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    size = _telling(source, digest_bytes)
    with small_batches(source.sparkSession):
        recipes = saved(source.mapInArrow(_recipes(size), f"doc_id {kind}, recipe binary, text_sha256 string"))
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # rows of a few dozen bytes meet their group in a join that adaptive execution can split
    out = recipes.join(groups, "recipe")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", digest_bytes: int = 16) -> DataFrame:
    """The columns ``keep`` of one row per text: of equal texts the row with the largest doc_id, and of several such
    rows the one that is largest in the other columns."""
    source = docs.select(F.col(doc_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    made = T.StructType([T.StructField("doc_id", source.schema["row_id"].dataType), T.StructField("recipe", T.BinaryType()), T.StructField("text_sha256", T.StringType()), source.schema["row"]])
    size, within = _telling(source, digest_bytes), text if text in keep else None
    cut = (source.drop("text") if within else source).mapInArrow(_recipes(size, ("row",), within), made)
    # the key is written with the rows, so it stays the same however often they are read
    with small_batches(source.sparkSession):
        rows = saved(cut.select("doc_id", "recipe", "row", F.monotonically_increasing_id().alias("row_key")))
    place = F.struct("doc_id", *[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(keep) if c not in (text, doc_id)], "row_key")
    last = rows.groupBy("recipe").agg(F.max(place).alias("last")).select("last.row_key")
    return rows.join(last, "row_key", "left_semi").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
