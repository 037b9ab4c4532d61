"""Embedding near-dedup by product quantisation with coarse inverted lists.

Fitted on the driver, on SAMPLE vectors at most (those with the least hash of their id): coarse centroids, and
per subspace a codebook for what a vector has beyond its centroid. Every vector of the table is then an entry
of the list of its nearest centroid, as a code of SUBSPACES bytes, and a query to the lists that could hold a link of
it. Beyond MOST_LISTS a list has finer ones, by a second codebook for what is beyond the centroid. A block (a piece of a list's queries against a piece of its entries) is one group of bounded size:
asymmetric distances come from a table look-up per query and subspace, and since a query has length 1, the true
cosine is at most the looked-up one plus the entry's quantisation error. Only pairs that this bound lets through
are computed exactly, so quantisation loses nothing; only the choice of probes could (tests measure the recall).

Probes. If e links with q, q - e has length sqrt(2 - 2 * least) at most. If e's centroid is c while q is nearer to b,
then q lies beyond the plane between b and c by no more than the part of q - e across that plane, so q.b - q.c <=
|b - c| * that part. In no direction can that part be longer than q - e itself; in a direction that has nothing to do
with q - e it has a standard deviation of the length by sqrt(dimensions). A query goes to every list within MARGIN of
these deviations (never more than the certain bound), at any number of lists. Dimensions are those that the sample's
residuals really fill.

Very large groups. Sample vectors around which many others crowd get centroids of their own. Entries within half
the threshold's angle of their centroid are the list's *core*: any two of them are linked, by the triangle
inequality of angles, so they are counted and hung on the core's smallest id without a comparison; and entries
and queries whose angles to the centroid differ by more than the threshold's can't be linked and never meet.
A block gives one count a query, and a spanning forest of its links, so what it returns is linear in its rows.

Cases: a vector that is null, zero, or that holds null or non-finite components, links with nothing and keeps its own
id. Vectors of different lengths have no cosine; each length that two vectors have is compared among its own.
Components keep their precision: floats of a float column, doubles of any other. Ties: the component's id is its smallest vec_id. Rows that share a
vec_id are never linked with each other, and share their counts' sum and component. A null vec_id gives a null
component. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from silvagrid.llm.common import components, joined_small, saved, table

SAMPLE, MARGIN, SUBSPACES, CODEWORDS, MOST_LISTS, MOST_FINE = 8192, 3.0, 8, 32, 2048, 32
#: A list for about so many vectors; a centroid of its own for a crowd of so many in the sample.
LIST_VECTORS, CROWD = 128, 8
BLOCK_ENTRIES, BLOCK_QUERIES = 2048, 4096
#: Vectors that are held against all centroids at a time.
SIDE_ROWS = 2048


def _units(column: pd.Series, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), f"f{len(column.iloc[0]) // dims}").reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """k-means; an empty cluster keeps its centre."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Index:
    def __init__(self, sample: np.ndarray, rows: int, least: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims, self.least = sample.shape[1], least
        self.theta = math.acos(least)
        self.core, self.near = math.cos(self.theta / 2 - 1e-6), math.cos(1.5 * self.theta + 1e-6)
        # leaders: sample vectors no two of which lie within half the angle; crowds get their own centroid
        free, leaders = np.ones(len(sample), bool), []
        for i in range(len(sample)):
            if free[i]:
                close = free & (sample @ sample[i] >= self.core)
                free &= ~close
                leaders.append((int(close.sum()), sample[close].mean(0)))
        crowds = [m / np.linalg.norm(m) for n, m in leaders if n >= CROWD]
        rest = np.array([m for n, m in leaders if n < CROWD]) if any(n < CROWD for n, _ in leaders) else np.zeros((0, self.dims))
        k = min(len(rest), max(1, min(MOST_LISTS, rows // LIST_VECTORS)))
        centres = [np.array(crowds).reshape(-1, self.dims)]
        if k:
            c = _means(rest, k, rng)
            size = np.linalg.norm(c, axis=1, keepdims=True)
            centres.append(np.where(size > 1e-9, c / np.maximum(size, 1e-9), rest[:1]))
        self.centres = np.concatenate(centres)
        own = (sample @ self.centres.T).argmax(1)
        residual = sample - self.centres[own]
        self.cuts = np.linspace(0, self.dims, min(SUBSPACES, self.dims) + 1).astype(int)
        self.apart = np.sqrt(np.maximum(((self.centres**2).sum(1)[:, None] - 2 * self.centres @ self.centres.T) + (self.centres**2).sum(1), 0)).astype(np.float32)
        spread = np.linalg.eigvalsh(residual.T @ residual)
        filled = spread.sum() ** 2 / (spread**2).sum() if spread.max() > 1e-12 else 1.0
        self.margin = min(1.0, MARGIN / math.sqrt(max(filled, 1.0))) * math.sqrt(2 - 2 * least) if least < 1 else 1e-9
        fine = min(MOST_FINE, len(sample), -(-rows // (LIST_VECTORS * MOST_LISTS)))
        self.fine = _means(residual, fine, rng) if fine > 1 else np.zeros((1, self.dims))
        self.fine_apart = np.linalg.norm(self.fine[:, None] - self.fine, axis=2)
        self.books = [_means(residual[:, a:b], min(CODEWORDS, len(sample)), rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what the code leaves out."""
        residual = x - self.centres[lists]
        out, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            r = residual[:, a:b]
            out[:, j] = (r @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            left += ((r - book[out[:, j]]) ** 2).sum(1)
        return out, np.sqrt(left)

    def probed(self, like: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists in which a link of each row could be; the nearest ``most`` where that is given."""
        if most is not None:
            k = min(most, like.shape[1])
            return np.repeat(np.arange(len(like)), k), np.argpartition(-like, k - 1, axis=1)[:, :k].reshape(-1)
        home = like.argmax(1)
        gap = like.max(1, keepdims=True) - like
        return np.nonzero((gap <= self.margin * self.apart[home] + 1e-9) | (like >= self.core))

    def _fine_scores(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return (x - self.centres[lists]) @ self.fine.T - 0.5 * (self.fine**2).sum(1)

    def fine_home(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return lists * len(self.fine) + self._fine_scores(x, lists).argmax(1)

    def fine_probed(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, fine list) of the fine lists of each row's list in which a link of it could be."""
        if len(self.fine) == 1:
            return np.arange(len(x)), lists
        score = self._fine_scores(x, lists)
        row, fine = np.nonzero(score.max(1, keepdims=True) - score <= self.margin * self.fine_apart[score.argmax(1)] + 1e-9)
        return row, lists[row] * len(self.fine) + fine

    def looked_up(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of queries with the entries' codes."""
        out = np.repeat((q @ self.centres[which])[:, None], len(codes), 1)
        for j, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (q[:, a:b] @ book.T)[:, codes[:, j]]
        return out


def _vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and, where a vector can be compared, its length and its components as bytes."""
    e = F.col(embedding)
    kind = rows.schema[vec_id].dataType.simpleString()
    held = np.float32 if isinstance(getattr(rows.schema[embedding].dataType, "elementType", None), FloatType) else np.float64

    def run(frames):
        for f in frames:
            xs, ds = [], []
            for v in f["embedding"]:
                x = None
                if v is not None and len(v):
                    x = np.asarray([np.nan if c is None else c for c in v] if getattr(v, "dtype", None) == object else v, np.float64)
                    most = np.abs(x).max()
                    # lengths whose squares leave the range are scaled first
                    x = (x if 1e-18 < most < 1e18 else x / most).astype(held).tobytes() if 0 < most < np.inf else None
                xs.append(x)
                ds.append(None if x is None else len(v))
            yield pd.DataFrame({"vec_id": f["vec_id"], "dims": pd.array(ds, "Int32"), "x": xs})

    return saved(rows.select(F.col(vec_id).alias("vec_id"), e.cast("array<double>").alias("embedding")).mapInPandas(run, f"vec_id {kind}, dims int, x binary"))


def _dealt(sides: DataFrame) -> DataFrame:
    """Each entry to the query pieces of its part of the list, each query to the entry pieces; (part, list, e, q) is
    a block. Lists without entries or without queries have none."""
    entries, queries = F.sum(F.col("entry").cast("long")), F.sum((~F.col("entry")).cast("long"))
    pieces = saved(
        sides.groupBy("part", "list").agg(F.ceil(entries / BLOCK_ENTRIES).alias("es"), F.ceil(queries / BLOCK_QUERIES).alias("qs")).where("es > 0 AND qs > 0")
    )
    held = joined_small(sides.drop("core"), pieces, ["part", "list"], "inner", pieces.count())
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("entry"), F.col("es")).otherwise(F.col("qs"))).cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("entry"), F.col("qs")).otherwise(F.col("es")).cast("int") - 1)).alias("other")
    cut = held.select("part", "list", "entry", "vec_id", "x", "code", "left", own, other)
    e, q = F.when(F.col("entry"), F.col("own")).otherwise(F.col("other")), F.when(F.col("entry"), F.col("other")).otherwise(F.col("own"))
    return cut.select("part", "list", "entry", "vec_id", "x", "code", "left", e.alias("e"), q.alias("q"))


def links_of(vectors: DataFrame, dims: int, least: float = 0.9, probes: int | None = None):
    """(counts: vec_id, n_links, not yet summed; edges: u, v with the same components as all links), among
    vectors of one length. ``probes`` fixes the number of lists that a query goes to."""
    spark = vectors.sparkSession
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.col("dims") == dims)).drop("dims")
    rows = usable.count()
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    index = Index(_units(sample["x"], dims), rows, least)
    shipped = spark.sparkContext.broadcast(index)

    def sides(frames):
        ix = shipped.value
        for whole in frames:
            for s in range(0, len(whole), SIDE_ROWS):
                f = whole.iloc[s : s + SIDE_ROWS]
                x = _units(f["x"], dims)
                like = x @ ix.centres.T
                home = like.argmax(1)
                codes, left = ix.codes(x, home)
                ids, raw = f["vec_id"].to_numpy(), f["x"].to_numpy()
                at_home = like[np.arange(len(x)), home]
                # entries: part a among what is not core, part b near entries for inner queries, part c core entries for near queries
                core, near = at_home >= ix.core, at_home >= ix.near
                for part, mask in (("a", ~core), ("b", near & ~core), ("c", core)):
                    if mask.any():
                        lists = ix.fine_home(x[mask], home[mask]) if part == "a" else home[mask]
                        yield pd.DataFrame({"part": part, "list": lists.astype(np.int32), "entry": True, "core": part == "c", "vec_id": ids[mask], "x": raw[mask], "code": [c.tobytes() for c in codes[mask]], "left": left[mask]})
                owner, lists = ix.probed(like, probes)
                angle = like[owner, lists]
                inner, by = angle >= ix.core, angle >= ix.near
                for part, mask in (("a", ~inner), ("b", inner), ("c", by & ~inner)):
                    o, to = owner[mask], lists[mask]
                    for t in range(0, len(o), 16 * SIDE_ROWS):
                        ot, lt = o[t : t + 16 * SIDE_ROWS], to[t : t + 16 * SIDE_ROWS]
                        if part == "a":
                            row, lt = ix.fine_probed(x[ot], lt)
                            ot = ot[row]
                        yield pd.DataFrame({"part": part, "list": lt.astype(np.int32), "entry": False, "core": part == "b", "vec_id": ids[ot], "x": raw[ot], "code": None, "left": np.nan})

    made = saved(usable.mapInPandas(sides, "part string, list int, entry boolean, core boolean, vec_id long, x binary, code binary, left double"))
    # the core: linked without comparison
    cores = made.where("entry AND core").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    inside = made.where("NOT entry AND core").select("list", "vec_id").join(F.broadcast(cores), "list")  # a row a list: at most MOST_LISTS and the crowds
    at_home = made.where("entry AND core").select("list", "vec_id", F.lit(1).alias("own"))
    core_counts = inside.select("vec_id", F.col("n").alias("n_links")).union(at_home.select("vec_id", F.lit(-1).cast("long")))
    core_edges = inside.select(F.col("first").alias("u"), F.col("vec_id").alias("v"))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        ix = shipped.value
        e, q = frame[frame["entry"]], frame[~frame["entry"]]
        empty = pd.DataFrame({"u": pd.array([], "int64"), "v": pd.array([], "int64"), "n": pd.array([], "int64")})
        if not len(e) or not len(q):
            return empty
        which = int(frame["list"].iloc[0])
        if frame["part"].iloc[0] == "a":
            which //= len(ix.fine)
        codes = np.frombuffer(b"".join(e["code"]), np.uint8).reshape(len(e), -1)
        xe, xq, ide, idq = _units(e["x"], dims), _units(q["x"], dims), e["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        bound = e["left"].to_numpy() + 1e-9
        count, pairs = np.zeros(len(q), np.int64), []
        for a in range(0, len(q), 512):
            may = ix.looked_up(xq[a : a + 512], which, codes) + bound >= ix.least
            i, j = np.nonzero(may)
            if not len(i):
                continue
            if len(i) > may.size // 8:
                true = (xq[a : a + 512] @ xe.T)[i, j]
            else:
                true = np.concatenate([np.einsum("ij,ij->i", xq[a + i[s : s + 65536]], xe[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
            ok = (true >= ix.least) & (idq[a + i] != ide[j])
            i, j = i[ok] + a, j[ok]
            count += np.bincount(i, minlength=len(q))
            # a query's links to one piece hang together through the query: keep each query's first, and each entry's
            pairs.append((i, j))
        if not count.any():
            return empty
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        label = _forest(np.concatenate([idq, ide]), i, j + len(idq))
        nodes = np.concatenate([idq, ide])
        hung = label != nodes
        edges = pd.DataFrame({"u": label[hung], "v": nodes[hung], "n": 0})
        some = count > 0
        return pd.concat([edges, pd.DataFrame({"u": idq[some], "v": idq[some], "n": count[some]})]).astype("int64")

    found = saved(_dealt(made).groupBy("part", "list", "e", "q").applyInPandas(block, "u long, v long, n long"))
    counts = core_counts.union(found.where("n > 0").select(F.col("u").alias("vec_id"), F.col("n").alias("n_links")))
    edges = core_edges.union(found.where("n = 0").select("u", "v")).where("u <> v")
    return counts, edges


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each node over links (i, j)."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, probes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row."""
    vectors = _vectors(rows, vec_id, embedding)
    lengths = vectors.where("dims IS NOT NULL AND vec_id IS NOT NULL").groupBy("dims").count().where("count > 1").orderBy("dims").collect()
    if not lengths:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = zip(*(links_of(vectors, r.dims, least, probes) for r in lengths), strict=True)
    counts, edges = reduce(DataFrame.union, counts), reduce(DataFrame.union, edges)
    counts = counts.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    of = components(edges).withColumnRenamed("id", "vec_id")
    out = vectors.select("vec_id").join(counts, "vec_id", "left").join(of, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
