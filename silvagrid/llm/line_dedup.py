"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit (a character inserted, deleted or replaced) just if they have a variant in common
among themselves and their one-character deletions. Every line that could have such a partner emits its variants
as hashed keys, equal keys meet, the edit distance is verified on the lines themselves, and of each linked pair
the later line goes.

What goes: a line of any length that equals a line before it, at a smaller doc_id or earlier in the same document,
or a line of MIN_CHARS characters or more that is within one edit of such a line of MIN_CHARS or more; "before" is
judged on the input, whether or not that line stays. Lines are what stands between line feeds; empty lines always
stay. Shorter lines are held to equality, as one edit makes another word or number of them.

The work is kept linear in three steps. Equal lines are one *form*, with its first place, by an aggregation that
combines on the map side. A form emits variants only if it shares its first or last half with another form of its
length or of one character more or less, and only for places in the other half (were the edit to lie in one half, the
other is equal). And what meets under a key is decided by two minima:

* A replacement leaves equal variants without the *same place*. The place is part of the key, so forms under it differ
  in that place alone: all are within one edit of each other, and the earliest removes the others.
* An insertion makes a variant of the longer line equal to the shorter line as a whole. One form at most is the whole
  under a key; it is held against the earliest variant, and removes the variants that come later.

Every pair that decides is verified by its edit distance; where keys of 64 bits met by chance, all pairs of such a key
are compared.

Cases: a null text has no lines and keeps the digest of the empty text. Ties are broken by (doc_id, line). Rows
that share a doc_id share places; equal places are not before each other. Repeated rows each give a row. A null
doc_id comes first. Extra columns are ignored; an empty table gives an empty result. Ids of any type that can be
ordered will do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import dropped, mix64, saved, slices, table

MIN_CHARS = 16
_P = np.uint64(0x9E3779B97F4A7C15)
#: What a form is to emit: places of the second or first half for a replacement, the same as the longer line of an
#: insertion, and itself as the shorter one.
REPLACED_LATE, REPLACED_EARLY, INSERTED_LATE, INSERTED_EARLY, WHOLE = 1, 2, 4, 8, 16
#: Kinds of keys.
BY_PLACE, AS_VARIANT, AS_WHOLE = 0, 1, 2


def without_each(line: str) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the line without each of its places, and of the whole line: from hashes of what stands before and
    after each place."""
    c = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[:n], dtype=np.uint64)])
        # without place i, what follows moves one place down: multiply the rest up instead, to keep to whole numbers
        return mix64(before[:n] * _P + (before[n] - before[1:])), mix64(before[n : n + 1] * _P)[0]


def keys_of(line: str, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of the variants that ``wanted`` names."""
    n = len(line)
    without, whole = without_each(line)
    keys, kinds = [], []
    half, short = n // 2, (n - 1) // 2  # the half of a partner of this length, and of one character less
    lots = np.zeros(n, bool)
    if wanted & REPLACED_LATE:
        lots[half:] = True
    if wanted & REPLACED_EARLY:
        lots[:half] = True
    at = np.flatnonzero(lots)
    if len(at):
        with np.errstate(over="ignore"):
            keys.append(mix64(without[at] + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
        kinds.append(np.full(len(at), BY_PLACE, np.int8))
    lots[:] = False
    if wanted & INSERTED_LATE:
        lots[short:] = True
    if wanted & INSERTED_EARLY:
        lots[: short + 1] = True
    if lots.any():
        keys.append(np.unique(without[lots]))
        kinds.append(np.full(len(keys[-1]), AS_VARIANT, np.int8))
    if wanted & WHOLE:
        keys.append(np.array([whole]))
        kinds.append(np.array([AS_WHOLE], np.int8))
    return np.concatenate(keys), np.concatenate(kinds)


def within_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _lines(batches):
    """The lines of a batch, each form once a slice, with its first place."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            first: dict[str, tuple] = {}
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                known = d is not None
                for i, line in enumerate((t or "").split("\n")):
                    if line:
                        at = (known, d, i)
                        if line not in first or ((known, i) < (first[line][0], first[line][2]) if not (known and first[line][0]) else at < first[line]):
                            first[line] = at
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(x.encode(), digest_size=16).digest() for x in first], pa.binary()), pa.array(list(first), pa.string()), pa.array([p[1] for p in first.values()], part.column("doc_id").type), pa.array([p[2] for p in first.values()], pa.int64())],
                    names=["form", "line", "doc_id", "place"],
                )


def _neighbourhood(batches):
    for batch in batches:
        for a, b in slices(batch.column("line"), 1 << 17):
            part = batch.slice(a, b - a)
            made = [keys_of(t, w) for t, w in zip(part.column("line").to_pylist(), part.column("wanted").to_pylist(), strict=True)]
            index = pa.array(np.repeat(np.arange(part.num_rows), [len(k) for k, _ in made]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in made]).view(np.int64)), pa.array(np.concatenate([k for _, k in made])), *(part.column(c).take(index) for c in ("fid", "doc_id", "place"))], names=["key", "kind", "fid", "doc_id", "place"])


def _wanted(forms: DataFrame, least: int) -> DataFrame:
    """(fid, wanted): which forms share a half with another of about their length, and what they are to emit."""
    n = F.length("line")

    def half(side: str, longer: bool) -> Column:
        m = n - 1 if longer else n  # the shorter line's length
        h = F.floor(m / 2).cast("int")
        piece = F.substring("line", 1, h) if side == "<" else F.substring("line", n - (m - h) + 1, m - h)
        return F.struct(F.xxhash64(F.lit(side), m, piece).alias("key"), F.lit(longer).alias("longer"), F.lit(side == "<").alias("late"))

    long_enough = forms.where(n >= least)
    halves = long_enough.select("fid", F.explode(F.array(half("<", False), half(">", False), half("<", True), half(">", True))).alias("x"), n.alias("n")).select("fid", "x.*", "n")
    halves = halves.where(f"NOT longer OR n > {least}").select("fid", "key", "longer", "late")
    met = halves.groupBy("key").agg(F.sum((~F.col("longer")).cast("int")).alias("own"), F.sum(F.col("longer").cast("int")).alias("one_more")).where("own > 1 OR (own > 0 AND one_more > 0)")
    flag = (
        F.when(F.col("longer"), F.when(F.col("own") > 0, F.when(F.col("late"), INSERTED_LATE).otherwise(INSERTED_EARLY)).otherwise(0))
        .otherwise(F.when(F.col("own") > 1, F.when(F.col("late"), REPLACED_LATE).otherwise(REPLACED_EARLY)).otherwise(0).bitwiseOR(F.when(F.col("one_more") > 0, WHOLE).otherwise(0)))
    )
    return halves.join(met, "key").groupBy("fid").agg(F.bit_or(flag).alias("wanted")).where("wanted > 0")


def near_lines(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id", least: int = MIN_CHARS):
    """(forms: fid, line, doc_id and place of the first; forms that go: fid)."""
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    seen = source.mapInArrow(_lines, f"form binary, line string, doc_id {kind}, place long")
    # the digest of 128 bits stands for the line; its text goes along once
    forms = seen.groupBy("form").agg(F.min_by("line", F.struct("doc_id", "place")).alias("line"), F.min(F.struct("doc_id", "place")).alias("at"))
    forms = saved(forms.select(F.monotonically_increasing_id().alias("fid"), "line", "at.doc_id", "at.place"))
    some = saved(forms.join(_wanted(forms, least), "fid"))
    keys = saved(some.mapInArrow(_neighbourhood, f"key long, kind byte, fid long, doc_id {kind}, place long"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).where(f"n > 1 AND (low = {BY_PLACE} OR low < high)").select("key")
    met = saved(keys.join(shared, "key").select("key", "kind", "fid", F.struct("doc_id", "place").alias("at")))
    at = F.struct("at", "fid")
    leads = met.groupBy("key").agg(F.min(F.when(F.col("kind") != AS_WHOLE, at)).alias("lead"), F.min(F.when(F.col("kind") == AS_WHOLE, at)).alias("whole"))
    other = F.when(F.col("kind") == AS_VARIANT, F.col("whole")).otherwise(F.col("lead"))
    pairs = met.join(leads, "key").withColumn("other", other).where("other.at < at").select("key", F.col("fid").alias("f"), F.col("other.fid").alias("g"))
    lines = some.select("fid", "line")

    def held(pairs: DataFrame) -> DataFrame:
        one, two = lines.toDF("f", "x"), lines.toDF("g", "y")
        return pairs.join(one, "f").join(two, "g").withColumn("near", F.levenshtein("x", "y", 1) >= 0)

    tried = saved(held(pairs).select("key", "f", "near"))
    gone = tried.where("near").select("f")
    chance = tried.where("NOT near").select("key").distinct()
    if not chance.isEmpty():
        own = met.join(chance, "key")
        both = own.select("key", F.col("fid").alias("f"), F.col("at").alias("p")).join(own.select("key", F.col("fid").alias("g"), F.col("at").alias("q")), "key").where("q < p").select("f", "g").distinct()
        gone = gone.union(held(both).where("near").select("f"))
    gone = saved(gone.distinct().select(F.col("f").alias("fid")))
    for x in (some, keys, met, tried):
        dropped(x)
    return forms, gone


def deduplicated(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id", least: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept_text: one row per row of docs."""
    text = F.col(text) if isinstance(text, str) else text
    forms, near = near_lines(docs, text, doc_id, least)
    # places that stay: the first place of each form that no earlier form removes
    stay = forms.select("fid", "doc_id", "place").join(near, "fid", "left_anti").groupBy(F.col("doc_id").alias("at_doc")).agg(F.collect_list(F.col("place").cast("int")).alias("stay"))
    source = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    both = source.join(stay, F.col("doc_id").eqNullSafe(F.col("at_doc")), "left").select("doc_id", "text", "stay")

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                n, removed, sha, kept = [], [], [], []
                for t, stay in zip(part.column("text").to_pylist(), part.column("stay").to_pylist(), strict=True):
                    lines = t.split("\n") if t is not None else []
                    own = set(stay or ())
                    keep = [x for i, x in enumerate(lines) if not x or i in own]
                    out = "\n".join(keep)
                    n.append(len(lines))
                    removed.append(len(lines) - len(keep))
                    sha.append(hashlib.sha256(out.encode()).hexdigest())
                    kept.append(out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"])

    return both.mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string, kept_text string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept_text")
