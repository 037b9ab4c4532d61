"""Near-duplicate documents by a signature-coordinate inverted join.

Every document becomes the set of its distinct word shingles (64-bit hashes) and a signature: the least value
of the set under each of COORDINATES hash functions. Documents with equal sets form one class, and one document
of a class goes on. It is posted under each (coordinate, value) pair. Two documents whose sets have the wanted
similarity agree in at least MATCHES coordinates but for a chance of about 3e-5 at the threshold itself (less
above it); pairs that agree in as many are confirmed on the full sets.

Merging the posting lists:

* Prefix. Order the pairs by the length of their lists. Among a document's k pairs that others share, MATCHES
  agreements can't all lie behind the first k - MATCHES + 1, so it is posted under these, the rarest, only; a
  document with fewer than MATCHES shared pairs is posted nowhere. Long lists are hardly ever merged.
* Skip. The long lists are not read: agreements in them are counted from the two signatures.
* Stars. Of each list, every member is held against one member, which a hash of the list and the id chooses: another
  in most lists, so that one document unlike its group does no harm. Confirmed links are contracted to components.
  Within a component nothing is left to find.
* Bitmaps. A set's bitmap has a bit for the parity of its shingles in each of BITS places. Two bitmaps differ in no more
  bits than the sets differ in shingles, so pairs that differ in too many can't link and go unread.
* Lists that still hold several components. All pairs of such a list would grow with its square, and nearly all
  would fail. Their members are joined once more, now exactly, on the shingles themselves: in order of how many of
  these members have a shingle, rarest first, two sets with the wanted overlap share a shingle among the first few
  of both (how few depends on the two sizes, so the postings carry a class of sizes). A shingle that makes a
  document unlike its group stands first, so documents that link with nothing hardly meet anyone. Keys under which
  one component stands alone are skipped, and where others stand beside it, its members don't meet each other. There
  is no cap on partners, lists or candidates.

Cases: a text that is null, empty or white space has the empty set, links with nothing and keeps its own id. A
text with fewer words than a shingle is one shingle of all its words. Ties: the component's id is its smallest
doc_id. Repeated rows fall into one class and each gives a row. Rows that share a doc_id share a component, which
has the links of all their texts. A null doc_id gives a null component, and is kept. Extra columns are ignored; an
empty table gives an empty result. Ids of any type that can be ordered will do.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import components, dropped, gathered, joined_small, mix64, saved, slices, small_batches, table, text_bytes

COORDINATES, MATCHES = 32, 18
#: Sizes whose logarithms to this base have the same whole part are of one class.
SIZE_BASE = 1.05
BITS = 2048
#: Bytes of text that are hashed at a time; the arrays for these take about forty times as much.
SLICE = 256 << 10
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SALT = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = np.uint64(0x100000001B3)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(column)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    n_rows = len(offsets) - 1
    if not len(low):
        return [np.zeros(0, np.uint64)] * n_rows
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    before = np.concatenate([[False], solid[:-1] & (row[1:] == row[:-1])])
    start = np.flatnonzero(solid & ~before)
    if not len(start):
        return [np.zeros(0, np.uint64)] * n_rows
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, start)  # words are runs of places in ``at``
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), _P, np.uint64)]))
        word = mix64(np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * power[place], first) + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        n = len(word)
        joined = np.zeros(n, np.uint64)
        for k in range(width):  # shingles that begin at each word, where enough words follow
            joined[: max(0, n - k)] = joined[: max(0, n - k)] * np.uint64(0xD6E8FEB86659FD93) + word[k:]
        joined = mix64(joined)
    owner = row[start]
    bounds = np.searchsorted(owner, np.arange(n_rows + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:  # all words as one; the number of words is mixed in
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
            out.append(mix64(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit word for each coordinate, which holds the coordinate and the least value."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 2048):
            np.minimum(least, (hashes[i : i + 2048, None] * _A + _B).min(0), out=least)
    return mix64(least ^ _SALT).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, as 64-bit words: the parity of the number of hashes in each place."""
    odd = np.bincount((hashes >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _alike(percent: int, n: str, o: str, p: str, q: str) -> Column:
    """Whether sets of n and o shingles with bitmaps p and q may have the similarity."""
    apart = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    both = F.col(n) + F.col(o)
    return (both - apart) * (100 + percent) >= 2 * percent * both


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "pairs"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text"), width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), hashes, pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "hashes", "bits"])

    return run


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_BASE)).cast("int")


class _Join:
    """The inverted join over the classes of one table, whose doc_id tells its rows apart."""

    def __init__(self, source: DataFrame, width: int, percent: int, matches: int):
        self.percent, self.matches = percent, matches
        kind = source.schema["doc_id"].dataType.simpleString()
        with small_batches(source.sparkSession):
            self.sketches = saved(source.mapInArrow(_sketches(width), f"doc_id {kind}, n_shingles long, set_id binary, pairs array<long>"))
        self.classes = gathered(self.sketches.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep")), "set_id")
        self.reps = self.sketches.join(self.classes, "set_id").where("doc_id = rep").select("doc_id", "n_shingles", "pairs")
        posted = self.reps.select("doc_id", F.explode("pairs").alias("pair"))
        lengths = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = posted.join(lengths, "pair").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("shared"))
        shared = shared.where(F.size("shared") >= matches)
        self.docs = gathered(shared.select("doc_id", F.col("shared.pair").alias("shared")).join(self.reps, "doc_id"), "doc_id")
        chosen = joined_small(source, self.docs.select("doc_id"), "doc_id", "left_semi", self.docs.count())
        with small_batches(source.sparkSession):
            self.hashes = saved(chosen.mapInArrow(_sets(width), f"doc_id {kind}, hashes array<long>, bits array<long>"))

    def components(self) -> DataFrame:
        """id, component of every document with a link."""
        first = self._confirmed(self._stars())
        of = components(first, write=gathered)
        dropped(first)
        pairs, used = self._rest(of)
        more = self._confirmed(pairs)
        # the components so far are links too
        out = components(of.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more), write=gathered)
        for x in (*used, more, self.docs, self.hashes):
            dropped(x)
        return out

    def _posted(self) -> DataFrame:
        k = F.size("shared")
        return self.docs.select("doc_id", "n_shingles", F.explode(F.slice("shared", 1, k - self.matches + 1)).alias("pair"))

    def _stars(self) -> DataFrame:
        """Each list's members against the one that the hash chooses."""
        placed = self._posted().select("pair", "doc_id")
        centres = placed.groupBy("pair").agg(F.min_by("doc_id", F.xxhash64("pair", "doc_id")).alias("u"), F.count(F.lit(1)).alias("m")).where("m > 1")
        met = placed.join(centres, "pair").where("doc_id <> u")
        return met.select(F.least("u", "doc_id").alias("u"), F.greatest("u", "doc_id").alias("v")).distinct()

    def _rest(self, of: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Pairs of different components, among the members of lists that hold several, which share a shingle early
        enough to have the wanted overlap; and the tables that these are read from."""
        t = self.percent
        placed = self._posted().join(of.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = placed.groupBy("pair").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("pair")
        members = gathered(placed.join(mixed, "pair").select("doc_id", F.col("n_shingles").alias("n"), "component").distinct(), "doc_id")
        words = members.join(self.hashes.select("doc_id", "hashes"), "doc_id").select("doc_id", "n", "component", F.explode("hashes").alias("w"))
        often = words.groupBy("w").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
        ordered = words.join(often, "w").groupBy("doc_id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("words"))
        # shingles that no other member has come first: they need no posting, but have their places
        at = ordered.select("doc_id", "n", "component", (F.col("n") - F.size("words")).alias("alone"), F.posexplode("words.w").alias("p", "w"))
        at = at.withColumn("left", F.col("n") - F.col("alone") - F.col("p")).where(100 * F.col("left") >= t * F.col("n"))
        # sets of sizes n and o link with an overlap of t (n + o) / (100 + t) or more; the smaller one offers, the larger one
        # asks, for partners no larger than itself that so much of itself can still satisfy
        most = F.least(F.col("n"), F.floor(F.col("left") * (100 + t) / t).cast("long") - F.col("n"))
        least = F.ceil(t * F.col("n") / 100).cast("long")
        offers = at.where(F.col("left") * (100 + t) >= 2 * t * F.col("n")).select("w", _size_class(F.col("n")).alias("c"), F.lit(True).alias("offer"), "doc_id", "n", F.col("n").alias("most"), "component")
        asks = at.where(most >= least).select("w", F.explode(F.sequence(_size_class(F.greatest(least, F.lit(1))), _size_class(most))).alias("c"), F.lit(False).alias("offer"), "doc_id", "n", most.alias("most"), "component")
        posts = gathered(offers.union(asks), "doc_id")
        parts = posts.groupBy("w", "c", "component").agg(F.count(F.lit(1)).alias("m"), F.max("offer").alias("o"), F.max(~F.col("offer")).alias("a"))
        keys = parts.groupBy("w", "c").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("o").alias("o"), F.max("a").alias("a")).where("parts > 1 AND o AND a").select("w", "c", "main")
        live = posts.join(keys, ["w", "c"]).join(self.hashes.select("doc_id", "bits"), "doc_id").withColumn("main", F.col("component") == F.col("main"))
        # lane 0: offers beside the main component to all who ask; lane 1: its own offers to the others
        one = live.where("offer").select("w", "c", F.col("main").cast("int").alias("lane"), F.col("doc_id").alias("x"), F.col("n").alias("size"), F.col("component").alias("cx"), F.col("bits").alias("p"))
        two = live.where("NOT offer").select("w", "c", F.explode(F.when(F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("lane"), F.col("doc_id").alias("y"), "n", "most", F.col("component").alias("cy"), F.col("bits").alias("q"))
        pairs = one.join(two, ["w", "c", "lane"]).where("size <= most AND cx <> cy").where(_alike(t, "size", "n", "p", "q")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        return pairs, [members, posts]

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs u, v those that agree in enough coordinates, and then on the full sets."""
        side, bits = self.docs.select("doc_id", "n_shingles", "pairs"), self.hashes.select("doc_id", "bits")
        near = pairs.join(side.toDF("u", "n", "p"), "u").join(side.toDF("v", "o", "q"), "v")
        near = near.where(100 * F.least("n", "o") >= self.percent * F.greatest("n", "o")).where(F.size(F.array_intersect("p", "q")) >= self.matches).select("u", "v", "n", "o")
        near = near.join(bits.toDF("u", "x"), "u").join(bits.toDF("v", "y"), "v").where(_alike(self.percent, "n", "o", "x", "y")).select("u", "v", "n", "o")
        sets = self.hashes.select("doc_id", "hashes")
        full = near.join(sets.toDF("v", "b"), "v").join(sets.toDF("u", "a"), "u")
        both = F.size(F.array_intersect("a", "b"))
        return gathered(full.where(both * (100 + self.percent) >= self.percent * (F.col("n") + F.col("o"))).select("u", "v"), "u", "v")


def near_duplicates(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs. ``matches`` is set by the similarity:
    four standard deviations below the mean number of agreements at the threshold."""
    if matches is None:
        p = percent / 100
        matches = max(2, int(COORDINATES * p - 4.4 * (COORDINATES * p * (1 - p)) ** 0.5))
    text = F.col(text) if isinstance(text, str) else text
    source, ids = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text")), None
    if not source.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        # doc_id doesn't tell the rows apart: keys in its order do
        keyed = saved(source.orderBy("doc_id").withColumn("row_key", F.monotonically_increasing_id()))
        source, ids = keyed.select(F.col("row_key").alias("doc_id"), "text"), keyed.select(F.col("row_key").alias("doc_id"), F.col("doc_id").alias("own"))
    join = _Join(source, width, percent, matches)
    of = join.components()
    if ids is not None:
        firsts = ids.where("own IS NOT NULL").groupBy("own").agg(F.min("doc_id").alias("v"))
        classes = join.sketches.select("doc_id", "set_id").join(join.classes, "set_id").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        same = ids.join(firsts, "own").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
        of = components(of.select(F.col("id").alias("u"), F.col("component").alias("v")).union(classes).union(same), write=gathered)
        least = of.join(ids.where("own IS NOT NULL").withColumnRenamed("doc_id", "id"), "id").groupBy("component").agg(F.min("own").alias("component_id"))
        to = of.join(least, "component").select(F.col("id").alias("doc_id"), "component_id")
        out = join.sketches.select("doc_id", "n_shingles").join(ids, "doc_id").join(to, "doc_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.when(F.col("own").isNotNull(), F.col("component_id")).alias("component_id"))
    else:
        to = join.classes.join(of.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
        out = join.sketches.select("doc_id", "n_shingles", "set_id").join(to, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, matches=MATCHES)
