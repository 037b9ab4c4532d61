"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of all pre-tokens of a batch that have not been met before form linked lists, end to end. Every
adjacent pair that the vocabulary can merge waits in the bucket of its merge rank as a list position, and a
two-level bitmap marks the ranks whose buckets hold something: find-first-set on the upper level and then on
one word of the lower gives the next rank. A bucket is taken as a whole: numpy merges all its positions,
skips stale entries (a position whose pair has another rank by now) and, of entries that overlap, takes every
other one from the left. The queue serves the whole batch because merges in one pre-token never touch
another. The work is proportional to the number of entries, whatever the length of a pre-token.

Merging a bucket at once equals merging its entries one by one as long as a merge doesn't make a pair of lower
rank. Where a vocabulary has such pairs, the ranks concerned are known on loading; of their buckets, each
pre-token's entries are taken up to the first that makes such a pair, and the others wait.

Text is split by the pattern first, by an equivalent for ``re`` where all characters are below U+0250.
Pre-tokens met before come from a table of bounded size.

Cases: a null text counts as empty and gives no ids. Repeated rows are each encoded; extra columns are ignored
or kept as asked; an empty table gives an empty result. Lone surrogates can't reach a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import slices, table

#: Pre-tokens that a process remembers at most; texts of about so many bytes are encoded together.
REMEMBERED, BATCH_BYTES = 500_000, 4 << 20
#: The pattern for which SIMPLE is an equivalent.
PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SIMPLE = re.compile(f" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-\u024f]")
_LOADED: dict[str, Codec] = {}


class RankQueue:
    """Buckets of list positions by rank, and a two-level bitmap of the ranks that have any."""

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.low: dict[int, int] = {}
        self.high = 0

    def push(self, rank: int, positions) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
        else:
            self.buckets[rank] = [positions]
            w = rank >> 6
            self.low[w] = self.low.get(w, 0) | 1 << (rank & 63)
            self.high |= 1 << w

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) > 64:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = np.concatenate([[0], cuts])
            for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*cuts.tolist(), len(ranks)], strict=True):
                self.push(r, positions[a:b])
        else:
            for r, p in zip(ranks.tolist(), positions.tolist(), strict=True):
                self.push(r, p)

    def pop(self) -> tuple[int, np.ndarray]:
        w = (self.high & -self.high).bit_length() - 1
        word = self.low[w]
        rank = (w << 6) + (word & -word).bit_length() - 1
        word &= word - 1
        if word:
            self.low[w] = word
        else:
            del self.low[w]
            self.high &= self.high - 1
        found = self.buckets.pop(rank)
        return rank, np.unique(np.hstack(found)) if len(found) > 1 else np.atleast_1d(found[0])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        whole = regex.compile(pattern).findall
        self.split = (lambda t: SIMPLE.findall(t) if not _OTHER.search(t) else whole(t)) if pattern == PUBLIC else whole
        keys, made = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                x, y = ranks.get(b[:i]), ranks.get(b[i:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array([*np.array(keys, np.int64)[order], np.iinfo(np.int64).max]), np.array([*np.array(made, np.int64)[order], -1])
        # tokens of which a merge can make a pair with a lower rank
        x, y = self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF
        self.careful = set(x[self.made[:-1] < x].tolist()) | set(y[self.made[:-1] < y].tolist())
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        """From a rank file; once a process."""
        if path not in _LOADED:
            with open(path, "rb") as f:
                _LOADED[path] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return _LOADED[path]

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x << 32 | y
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        token = self.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = sizes > 0
        after[ends[some] - 1] = -1
        before[(ends - sizes)[some]] = -1
        rank = np.full(n, -1, np.int64)  # of the pair that begins here
        at = np.flatnonzero(after >= 0)
        rank[at] = self.pair_rank(token[at], token[at + 1])
        queue = RankQueue()
        at = np.flatnonzero(rank >= 0)
        queue.push_all(rank[at], at)
        while queue.high:
            r, at = queue.pop()
            at = at[rank[at] == r]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                chained = np.concatenate([[False], at[1:] == after[at[:-1]]])
                if chained.any():
                    begin = np.flatnonzero(~chained)
                    at = at[(np.arange(len(at)) - begin[np.cumsum(~chained) - 1]) % 2 == 0]
                if r in self.careful:
                    at, rest = self._until_lower(r, at, token, after, before, word)
                    if len(rest):
                        queue.push(r, rest)
            gone = after[at]
            then = after[gone]
            token[at], after[at] = r, then
            token[gone], rank[gone], rank[at] = -1, -1, -1
            has = then >= 0
            right, nxt = at[has], then[has]
            before[nxt] = right
            prev = before[at]
            left = prev[prev >= 0]
            near = np.concatenate([right, left])
            if len(near):
                got = self.pair_rank(token[near], token[after[near]])
                rank[near] = got
                can = got >= 0
                if can.any():
                    queue.push_all(got[can], near[can])
        live = token >= 0
        return token[live].astype(np.int32), np.bincount(word[live], minlength=len(words))

    def _until_lower(self, r, at, token, after, before, word):
        """The entries up to each word's first whose merge makes a pair of lower rank, and the others."""
        me, then, prev = np.full(len(at), r, np.int64), after[after[at]], before[at]
        right = np.where(then >= 0, self.pair_rank(me, token[then]), -1)
        left = np.where(prev >= 0, self.pair_rank(token[prev], me), -1)
        twin = int(self.pair_rank(me[:1], me[:1])[0])
        lower = ((right >= 0) & (right < r)) | ((left >= 0) & (left < r)) | (0 <= twin < r)
        if not lower.any():
            return at, at[:0]
        seen = np.cumsum(lower) - lower
        begin = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        now = seen == seen[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        return at[now], at[~now]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's."""
        if len(self.number) > REMEMBERED:
            self.forget()
        known = len(self.number)
        get, split = self.number.__getitem__, self.split
        indices = [np.fromiter(map(get, split(t)), np.int32) for t in texts]
        if len(self.number) > known:
            fresh = [w.encode("utf-8") for w in list(self.number)[known:]]
            ids, n = self.merged(fresh)
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(n)])
        index = np.concatenate(indices) if indices else np.zeros(0, np.int32)
        n = self.offsets[index + 1] - self.offsets[index]
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.offsets[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words = np.cumsum([len(x) for x in indices])
        return out, np.concatenate([[0], np.concatenate([[0], ends])[words]]) if len(words) else np.zeros(1, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids end to end, and the byte offset at which each id begins (and the end)."""
        if not hasattr(self, "joined"):
            top = max(self.bytes_of) + 1
            parts = [self.bytes_of.get(i, b"") for i in range(top)]
            self.joined = np.frombuffer(b"".join(parts), np.uint8)
            self.part_size = np.array([len(p) for p in parts], np.int64)
            self.part_at = np.cumsum(self.part_size) - self.part_size
        n = self.part_size[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.part_at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.joined[at].tobytes(), np.concatenate([[0], ends])


def encode_texts(docs: DataFrame, path: str, pattern: str, text: Column | str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``, as the struct ``row``) with ids: array<int>. The rank file lies at the
    same path on every machine."""
    return _mapped(docs, path, pattern, text, keep, "ids array<int>", _lists)


def _lists(codec: Codec, texts: list[str]) -> list[pa.Array]:
    ids, offs = codec.encode_all(texts)
    return [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))]


def _digests_and_ids(codec: Codec, texts: list[str]) -> list[pa.Array]:
    return _digests(codec, texts, True)


def _digests(codec: Codec, texts: list[str], with_ids: bool = False) -> list[pa.Array]:
    ids, offs = codec.encode_all(texts)
    little, (back, at) = memoryview(ids.astype("<u4").tobytes()), codec.decode_all(ids)
    back, cuts, ends = memoryview(back), offs.tolist(), at[offs].tolist()
    ids_sha = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    back_sha = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    more = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
    return [pa.array(np.diff(offs), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), *more]


def encoded_digests(docs: DataFrame, path: str, pattern: str, text: Column | str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """n_tokens and the digests of the ids and of the bytes they decode to; ``ids``: with the ids themselves."""
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return _mapped(docs, path, pattern, text, keep, made, _digests_and_ids if ids else _digests)


def _mapped(docs: DataFrame, path: str, pattern: str, text: Column | str, keep: list[str] | None, made: str, make) -> DataFrame:
    from pyspark.sql import types as T

    keep = docs.columns if keep is None else keep
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    schema = T.StructType([source.schema["row"], *T._parse_datatype_string(made).fields])

    def run(batches):
        codec = Codec.load(path, pattern)
        for batch in batches:
            for a, b in slices(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("row"), *make(codec, [t or "" for t in part.column("text").to_pylist()])], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded: the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def back(column):
        codec = Codec.load(path, pattern)
        return column.map(lambda x: None if x is None else codec.decode(x))

    return encoded.withColumn("decoded", back(F.col(ids)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    return encoded_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep=["doc_id"]).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
