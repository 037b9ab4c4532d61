"""Mixing sources to target weights.

Each source's words, document after document, form one stream that is cut into blocks of a fixed length. The
mix is a list of slots. Every output shard draws how many of its slots each source gets: multinomial draws
conditioned on the sources' totals (that is, multivariate hypergeometric), so the totals are met exactly. A
source's slots are numbered through the shards; number t shows block perm(t mod blocks) of the epoch
t div blocks, where perm is a keyed Feistel permutation of the source's block indices, a new one for each
epoch. Slots and documents meet by a join on (source, block).

A document's place in its source's stream comes from two prefix sums: within buckets of a bounded number of
documents, and over the bucket totals, again in parts. No task sees all documents of a source.

Cases: a null text has no words; such documents, and those without words, are taken 0 times. A null source is
a source of its own and comes last. A source without words has target 0. Where all sources reach their cap of
``cap`` times their size, the mix is as large as the caps allow. Repeated rows are separate stretches of the
stream, and each has its own count, also where they share doc_id and text.
Extra columns are ignored by mix_counts() and kept by mix_documents(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvagrid.llm.common import BROADCAST_ROWS, mix64, saved, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
#: Documents of a source are dealt to buckets of about so many.
BUCKET_DOCS = 1_000
SHARD_SLOTS = 1 << 16
MOST_SHARDS = 4096
ROUNDS = 4


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) dealt out by weight; what a source can't take beyond cap * size is dealt again."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def _keys(seed: int, source: int, epoch: int) -> np.ndarray:
    d = hashlib.blake2b(f"{seed}/{source}/{epoch}".encode(), digest_size=8 * ROUNDS).digest()
    return np.frombuffer(d, "<u8")


def permuted(t: np.ndarray, n: int, keys: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), at the places t: a balanced Feistel network, walked on until
    the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = np.asarray(t, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        y = x[todo]
        left, right = y >> np.uint64(half), y & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & mask)
        y = (left << np.uint64(half)) | right
        x[todo] = y
        todo = todo[y >= n]
    return x.astype(np.int64)


def slots_for(words: int, size: int, block: int, keys_of) -> tuple[int, int]:
    """How many slots give ``words`` words of a source with ``size`` words, and how many words the last slot
    gives. Only a source's last block is shorter; its place in the epoch's order is looked up."""
    if not words or not size:
        return 0, 0
    n, full = math.ceil(size / block), words // size
    rest = words - full * size
    if not rest:
        last = permuted(np.array([n - 1]), n, keys_of(full - 1))[0]
        return full * n, size - (n - 1) * block if last == n - 1 else block
    short = size - (n - 1) * block
    at = int(permuted(np.array([n - 1]), n, keys_of(full), inverse=True)[0])  # where the short block comes
    if rest <= at * block:
        k = math.ceil(rest / block)
        return full * n + k, rest - (k - 1) * block
    rest -= at * block
    if rest <= short:
        return full * n + at + 1, rest
    k = math.ceil((rest - short) / block)
    return full * n + at + 1 + k, rest - short - (k - 1) * block


def _plan(docs: DataFrame, weights, share: float, cap: float, block: int, seed: int):
    """Documents with their stretch of their source's stream, and one row per source."""
    spark = docs.sparkSession
    per_source = docs.groupBy("source").agg(F.sum("size").alias("n_words"), F.count(F.lit(1)).alias("n_docs")).collect()  # one row a source
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [int(r.n_words) for r in per_source]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    rows = []
    for i, r in enumerate(per_source):
        slots, last = slots_for(round(goal[i]), sizes[i], block, lambda e, i=i: _keys(seed, i, e))
        rows.append((r.source, i, sizes[i], float(goal[i]), math.ceil(sizes[i] / block), max(1, math.ceil(r.n_docs / BUCKET_DOCS)), slots, last))
    sources = spark.createDataFrame(rows, "source string, source_no int, source_size long, target double, n_blocks long, n_buckets long, n_slots long, last_words int")
    return sources, rows


def placed(docs: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds start: the number of words before the document in its source's stream, whose order is by
    (bucket, doc_id, hash of the row's other key)."""
    side = F.broadcast(sources) if n_sources <= BROADCAST_ROWS else sources
    dealt = docs.join(side, docs.source.eqNullSafe(sources.source)).drop(sources.source)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("n_buckets")))
    totals = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_words"))
    # bucket totals: one row for BUCKET_DOCS documents; summed in parts of 1,024 buckets
    totals = totals.withColumn("part", F.floor(F.col("bucket") / 1024))
    parts = totals.groupBy("source_no", "part").agg(F.sum("bucket_words").alias("part_words"))
    before_part = parts.select("source_no", "part", (F.sum("part_words").over(Window.partitionBy("source_no").orderBy("part")) - F.col("part_words")).alias("before_part"))
    before = totals.join(before_part, ["source_no", "part"]).select("source_no", "bucket", (F.col("before_part") + F.sum("bucket_words").over(Window.partitionBy("source_no", "part").orderBy("bucket")) - F.col("bucket_words")).alias("before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return dealt.join(before, ["source_no", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def _shard_ranges(rows, seed: int):
    """(shard, source_no, first, count): how many slots each source gets in each shard, and their numbers.
    At most MOST_SHARDS times the number of sources; drawn here, as later draws depend on earlier ones."""
    slots = np.array([r[6] for r in rows], np.int64)
    total = int(slots.sum())
    n = max(1, min(MOST_SHARDS, math.ceil(total / SHARD_SLOTS)))
    rng, left, first, out = np.random.default_rng(seed), slots.copy(), np.zeros(len(slots), np.int64), []
    for shard in range(n):
        draw = left if shard == n - 1 else _hypergeometric(rng, left, math.ceil(left.sum() / (n - shard)))
        out += [(shard, i, int(first[i]), int(c)) for i, c in enumerate(draw) if c]
        first, left = first + draw, left - draw
    return out


def _hypergeometric(rng, left: np.ndarray, n: int) -> np.ndarray:
    """Multinomial counts conditioned on what each source has left, one source after another."""
    out, rest, n = np.zeros_like(left), int(left.sum()), int(n)
    for i, c in enumerate(left.tolist()):
        rest -= c
        if c and n:
            k = int(rng.hypergeometric(c, rest, n)) if c + rest < 10**9 else _drawn(rng, c, rest, n)
            out[i], n = k, n - k
    return out


def _fallen(c: int, k: int) -> float:
    """log of c (c - 1) ... (c - k + 1) / c ** k."""
    if c - k < 10**6:
        return math.lgamma(c + 1) - math.lgamma(c - k + 1) - k * math.log(c) if c else 0.0
    return -(c - k + 0.5) * math.log1p(-k / c) - k + 1 / (12 * c) - 1 / (12 * (c - k))


def _drawn(rng, c: int, rest: int, n: int) -> int:
    """A hypergeometric draw beyond numpy's limit of 1e9: a binomial one, taken with the quotient of the two
    probabilities, which is largest at the mean."""
    least, most = max(0, n - rest), min(c, n)
    if least == most:
        return least
    if 2 * n > c + rest:  # what stays behind is the smaller draw
        return c - _drawn(rng, c, rest, c + rest - n)
    quotient = lambda k: _fallen(c, k) + _fallen(rest, n - k)
    mean = n * c // (c + rest)
    top = max(quotient(min(most, max(least, mean + d))) for d in (-1, 0, 1, 2))
    while True:
        k = int(rng.binomial(n, c / (c + rest)))
        if least <= k <= most and math.log(1 - rng.random()) <= quotient(k) - top:
            return k


def slot_table(spark: SparkSession, rows, seed: int) -> DataFrame:
    """One row per slot: shard, slot (its number in the shard), source_no, epoch, block, words (null: all)."""
    ranges = _shard_ranges(rows, seed)
    blocks, slots, last = {r[1]: r[4] for r in rows}, {r[1]: r[6] for r in rows}, {r[1]: r[7] for r in rows}
    at, pieces = {}, []
    for shard, i, first, count in ranges:
        for a in range(first, first + count, SHARD_SLOTS):  # a piece of slots for one call
            c = min(SHARD_SLOTS, first + count - a)
            pieces.append((shard, i, a, c, at.get(shard, 0)))
            at[shard] = at.get(shard, 0) + c
    made = spark.createDataFrame(pieces or [(0, 0, 0, 0, 0)], "shard int, source_no int, first long, n long, at long")

    def fill(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                if not r.n:
                    continue
                n = blocks[r.source_no]
                t = np.arange(r.first, r.first + r.n)
                epoch, out = t // n, np.empty(len(t), np.int64)
                for e in np.unique(epoch):
                    own = epoch == e
                    out[own] = permuted(t[own] % n, n, _keys(seed, r.source_no, int(e)))
                words = pd.array([pd.NA] * len(t), "Int32")
                if t[-1] == slots[r.source_no] - 1:
                    words[-1] = last[r.source_no]
                yield pd.DataFrame({"shard": np.int32(r.shard), "slot": r.at + np.arange(len(t)), "source_no": np.int32(r.source_no), "epoch": epoch.astype(np.int32), "block": out, "words": words})

    n = max(1, min(len(pieces), spark.sparkContext.defaultParallelism * 4))
    return made.repartition(n, "shard", "first", "source_no").mapInPandas(fill, "shard int, slot long, source_no int, epoch int, block long, words int")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 20240607, text: Column | str = "text"):
    """(documents with their places, slots, pieces). A piece is a stretch of a document that a slot takes:
    shard, slot, epoch, source_no, block, doc_id, row_key, start, from_word, to_word (within the document). A row with words
    is told by its source_no and start, also where doc_id and text are repeated."""
    text = F.col(text) if isinstance(text, str) else text
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("row_key"))
    sized = saved(sized)
    sources, rows = _plan(sized, list(weights), share, cap, block, seed)
    places = placed(sized, sources, len(rows))
    slots = slot_table(docs.sparkSession, rows, seed)
    held = places.where("size > 0").select(
        "source_no", "doc_id", "row_key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    )
    # both sides grow with the input, and the planner can't know the size of what Python makes: no broadcast
    both = held.hint("merge").join(slots.hint("merge"), ["source_no", "block"])
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("block") * block + F.coalesce(F.col("words"), F.lit(block)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    pieces = both.where(end > begin).select("shard", "slot", "epoch", "source_no", "block", "doc_id", "row_key", "start", (begin - F.col("start")).alias("from_word"), (end - F.col("start")).alias("to_word"))
    return places, slots, pieces


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    places, _, pieces = mix(docs, **options)
    taken = pieces.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = taken.withColumnsRenamed({"source_no": "of_source", "start": "of_start"})
    # a row without words stands where the next one begins, and takes nothing
    own = (F.col("size") > 0) & (F.col("source_no") == F.col("of_source")) & (F.col("start") == F.col("of_start"))
    return places.join(taken, own, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document and epoch in which it is taken, a row with the words taken.
    Stretches that touch keep the text between them as it is; others are joined by a line end."""
    places, _, pieces = mix(docs, **options)
    words = F.sort_array(F.collect_list(F.struct(F.col("from_word").cast("int").alias("a"), F.col("to_word").cast("int").alias("b"))))
    spans = pieces.groupBy("doc_id", "row_key", "source_no", "start", "epoch").agg(words.alias("spans"))
    keyed = docs.withColumn("row_key", F.xxhash64("text"))
    row = ["doc_id", "row_key", "source_no"]
    if not places.where("size > 0").groupBy(*row).count().where("count > 1").isEmpty():
        # repeated rows are told by their starts, which only the spans have: one row stands for all
        keyed = keyed.dropDuplicates(["doc_id", "row_key", "source"])
    numbers = places.select(F.col("source").alias("of_source"), "source_no").distinct()
    named = spans.join(numbers, "source_no").withColumnsRenamed({"doc_id": "of_doc", "row_key": "of_key"})
    kept = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row_key") == F.col("of_key")) & F.col("source").eqNullSafe(F.col("of_source")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        word, out = re.compile(WORD), []
        for t, s in zip(text, spans, strict=True):
            at = [m.span() for m in word.finditer(t)]
            joined: list[list[int]] = []
            for x in s:
                if joined and joined[-1][1] == x["a"]:
                    joined[-1][1] = x["b"]
                else:
                    joined.append([x["a"], x["b"]])
            if len(joined) == 1 and joined[0] == [0, len(at)]:
                out.append(t)
            else:
                out.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in joined))
        return pd.Series(out)

    names = docs.columns
    new = kept.withColumn("text", cut("text", "spans"))
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*names)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
