"""Suffix-array dedup: later copies of long byte strings go, the first stays.

A byte is removed if a string of WIDTH bytes over it also begins earlier: at a smaller doc_id, or earlier in the
same document. That is where the longest previous factor, the longest string that begins here and also begins
earlier, is WIDTH or more. In the suffix order such a string is found at the previous or next smaller position: of
the suffixes that begin earlier, the nearest ones on both sides. An order cut off at WIDTH bytes, ties by position,
is enough.

No machine sorts the suffixes of all documents. They are dealt out so that equal WIDTH-byte strings meet:

1. Each string's *anchor* is its GRAM-byte substring with the least hash, leftmost if tied. Consecutive strings
   with one anchor form a *stretch*, about 1 for 33 bytes. Only hashes of the anchor and of the stretch move.
2. Where stretches meet under their anchor, one whose whole bytes came earlier is a copy as a whole. What is
   left over are the first of each kind; if an anchor has but one kind, nothing is to be compared.
3. Stretches of anchors with several kinds (ends of copies, common phrases) send their bytes. Their suffixes are
   sorted, and the array of longest previous factors is made from the previous and next smaller positions.
4. The removed places go back to their documents.

Equality in step 2 is of 128 bits of a universal hash, whose random keys don't depend on the texts, besides the anchor;
step 3 compares bytes. Anchors that very many documents have (found on a bounded sample of SAMPLE documents; a choice of
route only, which changes no result)
are dealt out by stretch, and their strings one by one, by their own hash; equal ones within a batch are reduced
to the first before they move. So no group of copies meets in one task.

Cases: a null text counts as empty. Documents under WIDTH bytes are kept whole. Rows that share a doc_id count as
one document, whose places are compared by start; repeated rows keep their bytes from each other. A null
doc_id comes before all others in order and is kept whole. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import mix64, saved, slices, table, text_bytes

WIDTH, GRAM = 100, 36
SAMPLE, COMMON = 2048, 0.01
#: Kernels work on about so many bytes at once.
PART_BYTES = 1 << 19
_TABLE = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_POWERS = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
#: Keys of four sums over the 32-bit words of a stretch's first and last WIDTH bytes, and over its number of strings.
_KEYS = np.random.default_rng(47).integers(0, 1 << 64, (2, WIDTH // 4, 4), dtype=np.uint64)
_SIZE_KEYS = np.random.default_rng(48).integers(0, 1 << 64, 4, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, up to n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 1 << 64)))
    return _POWERS[0][:n], _POWERS[1][:n]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes that begin at each place (zeros where fewer are left): differences of prefix sums of a
    polynomial, brought back to the power of their place."""
    n = len(raw)
    out = np.zeros(n, np.uint64)
    if n < GRAM:
        return out
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = _TABLE[raw]
        sums *= up
        np.cumsum(sums, out=sums)
        some = out[: n - GRAM + 1]
        some[:] = sums[GRAM - 1 :]
        some[1:] -= sums[: n - GRAM]
        some *= down[: n - GRAM + 1]
        some ^= some >> np.uint64(32)
        some *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each span of values (wrong within the last ones)."""
    n, width, now, other = len(values), 1, values, np.empty_like(values)
    while width < span:
        step = min(width, span - width)
        np.minimum(now[: n - step], now[step:], out=other[: n - step])
        other[n - step :] = now[n - step :]
        now, other = other, (np.empty_like(values) if now is values else now)
        width += step
    return now


def _stretches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    gram = _gram_hashes(raw)
    # the upper half of the hash, then the place: the least is the leftmost among equals
    low = np.uint64((1 << 32) - 1)
    least = _least((gram & ~low) | np.arange(len(raw), dtype=np.uint64), WIDTH - GRAM + 1)
    ends = offsets[1:] - WIDTH + 1  # where a row's last string has begun
    begins = offsets[:-1]
    long_enough = ends > begins
    cuts = np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begins[long_enough], ends[long_enough]])
    cuts = np.unique(cuts)
    row = np.searchsorted(offsets, cuts, "right") - 1
    size = np.diff(np.append(cuts, len(raw)))
    own = cuts + WIDTH <= offsets[row + 1]
    at, row, size = cuts[own], row[own], size[own]
    return row, at - offsets[row], size, gram[(least[at] & low).astype(np.int64)], at


def _kinds(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits (two columns) for the bytes of each stretch, which its first and last WIDTH bytes cover: the upper halves
    of four sums of 32-bit words times random keys. Two different stretches agree with a probability of 2 ** -128,
    whatever their bytes, as the keys don't depend on them."""
    strings = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
    with np.errstate(over="ignore"):
        sums = size.astype(np.uint64)[:, None] * _SIZE_KEYS
        for keys, places in zip(_KEYS, (at, at + size - 1), strict=True):
            sums += strings[places].view(np.uint32).astype(np.uint64) @ keys
    high = sums >> np.uint64(32)
    return (high[:, :2] << np.uint64(32)) | high[:, 2:]


def stretches(raw: np.ndarray, offsets: np.ndarray, kinds: bool = True) -> tuple[np.ndarray, ...]:
    """(row, start in the row, strings, anchor, kind) of the stretches of all rows. Rows are worked on in parts that stay
    in the processor's cache."""
    parts, n = [], len(offsets) - 1
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART_BYTES, "right")) - 1)
        if (np.diff(offsets[a : b + 1]) >= WIDTH).any():
            part = raw[offsets[a] : offsets[b]]
            row, start, size, anchor, at = _stretches(part, offsets[a : b + 1] - offsets[a])
            parts.append((row + a, start, size, anchor, _kinds(part, at, size) if kinds else np.zeros((len(row), 2), np.uint64)))
        a = b
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), np.zeros((0, 2), np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _again(kind: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each row, in this order, has the kind of the row before."""
    k = kind[order]
    return np.concatenate([np.zeros(min(1, len(k)), bool), (k[1:] == k[:-1]).all(1)])


def _stretch_rows(common: np.ndarray):
    """Stretches, once a batch for each kind (the others are copies of that one, and say so)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                raw, offsets = text_bytes(part.column("text"))
                row, start, size, anchor, kind = stretches(raw, offsets)
                if not len(row):
                    continue
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row]
                order = np.lexsort((start, doc, kind[:, 0]))
                again = _again(kind, order)
                copy = np.zeros(len(row), bool)
                # a copy in the batch comes later than the first of its kind; the same place twice is no copy
                lead = order[np.flatnonzero(~again)][np.cumsum(~again) - 1]
                copy[order] = again & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
                often = np.isin(anchor, common)
                route = np.where(copy, mix64(doc.view(np.uint64)), np.where(often, mix64(anchor ^ kind[:, 0]), anchor))
                kind = np.where(copy[:, None], np.uint64(0), kind)  # a known copy is not compared again
                anchor = np.where(copy, np.uint64(0), anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (route.view(np.int64), anchor.view(np.int64), kind[:, 0].view(np.int64), kind[:, 1].view(np.int64), doc, start.astype(np.int32), size.astype(np.int32), np.where(copy, 1, np.where(often, 3, 0)).astype(np.int8))],
                    names=["route", "anchor", "kind", "kind_low", "doc_id", "start", "n", "state"],
                )

    return run


def _columns(batches, names: list[str]) -> list | None:
    held = [[c if (c := b.column(k)).type == pa.binary() else c.to_numpy(zero_copy_only=False) for k in names] for b in batches if b.num_rows]
    if not held:
        return None
    return [pa.chunked_array([h[i] for h in held]) if isinstance(held[0][i], pa.Array) else np.concatenate([h[i] for h in held]) for i in range(len(names))]


def _met(batches):
    """State 1: a copy; 2: bytes are to be compared within the anchor; 3: string by string."""
    got = _columns(batches, ["anchor", "kind", "kind_low", "doc_id", "start", "n", "state"])
    if got is None:
        return
    anchor, high, kind_low, doc, start, n, state = got
    kind = np.stack([high, kind_low], axis=1)
    out = np.where(state == 1, 1, 0).astype(np.int8)
    live = np.flatnonzero(state != 1)
    order = live[np.lexsort((start[live], doc[live], kind_low[live], high[live], anchor[live]))]
    same_anchor = np.concatenate([[False], anchor[order[1:]] == anchor[order[:-1]]]) if len(order) else np.zeros(0, bool)
    same = same_anchor & _again(kind, order)
    if len(order):
        lead = order[np.flatnonzero(~same)][np.cumsum(~same) - 1]
        out[order] = same & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
        group = np.cumsum(~same_anchor) - 1
        kinds = np.bincount(group, ~same)
        # kinds of a common anchor lie in many partitions: none of them may be compared within the anchor here
        several = (kinds[group] > 1) & (state[order] != 3) & (out[order] == 0) & ~same
        out[order[several]] = 2
        often = order[(state[order] == 3) & (out[order] == 0) & ~same]
        out[often] = 3
    keep = out > 0
    yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(start[keep]), pa.array(n[keep]), pa.array(out[keep]), pa.array(anchor[keep])], names=["doc_id", "start", "n", "state", "anchor"])


def _packed(batches):
    """Texts compressed for the way."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            raw, offsets = text_bytes(part.column("text"))
            whole = memoryview(raw.tobytes())
            sizes = np.diff(offsets)
            packed = [codec.compress(whole[x:y], asbytes=True) if y > x else b"" for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(packed, pa.binary())], names=["doc_id", "n_bytes", "packed"])


def _unpacked(batch) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(p, n, asbytes=True) if n else b"" for p, n in zip(batch.column("packed").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)]


def _asked(batches):
    """The bytes of the stretches that are to be compared; those of common anchors string by string."""
    for whole in batches:
        for x in range(0, whole.num_rows, 256):
            batch = whole.slice(x, 256)
            route, doc, start, n, data = [], [], [], [], []
            seen: dict[bytes, int] = {}
            copies = []
            ids = batch.column("doc_id").to_pylist()
            texts, places = _unpacked(batch), batch.column("places").to_pylist()
            for i in np.argsort(np.array(ids), kind="stable").tolist():
                for p in sorted(places[i], key=lambda p: p["start"]):
                    a, m = p["start"], p["n"]
                    if p["state"] == 2:
                        route.append(p["anchor"])
                        doc.append(ids[i])
                        start.append(a)
                        n.append(m)
                        data.append(texts[i][a : a + m - 1 + WIDTH])
                        continue
                    for s in range(a, a + m):
                        w = texts[i][s : s + WIDTH]
                        if w in seen:
                            j = seen[w]
                            if (doc[j], start[j]) != (ids[i], s):
                                copies.append((ids[i], s))
                            continue
                        seen[w] = len(doc)
                        route.append(int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True))
                        doc.append(ids[i])
                        start.append(s)
                        n.append(1)
                        data.append(w)
            for d, s in copies:
                route.append(d)
                doc.append(d)
                start.append(s)
                n.append(1)
                data.append(None)  # known to be a copy
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(route, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["route", "doc_id", "start", "n", "data"])


def _smaller_before(time: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller time, or -1: pointers jump over what is not smaller."""
    n = len(time)
    at = np.arange(-1, n - 1)
    todo = np.arange(n)
    while len(todo := todo[at[todo] >= 0]) and len(todo := todo[time[at[todo]] >= time[todo]]):
        at[todo] = at[at[todo]]
    return at


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bytes, from the first on, in which rows of equal width (of whole 32-bit words) agree."""
    a, b = a.view("<u4"), b.view("<u4")
    apart = a != b
    word = apart.argmax(1)
    rows = np.arange(len(a))
    x = a[rows, word] ^ b[rows, word]
    within = ((x & 0xFF) == 0).astype(np.int64) + ((x & 0xFFFF) == 0) + ((x & 0xFFFFFF) == 0)
    return np.where(apart[rows, word], 4 * word + within, 4 * a.shape[1])


def longest_previous_factors(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each of the suffixes of raw at the places ``at``, the length (``width`` at most) of the longest string that
    begins there and also begins at an earlier one, when they are ordered in time by (doc, start). Each suffix has
    width bytes to go, and is cut off there. In the suffix order the longest match among the earlier ones is with
    the nearest earlier one before or the nearest earlier one behind."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(raw, width)[at]
    when = np.lexsort((start, doc))
    time = np.empty(n, np.int64)
    time[when] = np.cumsum(np.concatenate([[False], (doc[when[1:]] != doc[when[:-1]]) | (start[when[1:]] != start[when[:-1]])]))
    order = when[np.argsort(strings[when].view(f"S{width}")[:, 0], kind="stable")]  # ties by time
    strings, time = strings[order], time[order]
    found = np.zeros(n, np.int64)
    for mate in (_smaller_before(time), n - 1 - _smaller_before(time[::-1])[::-1]):
        own = np.flatnonzero((mate >= 0) & (mate < n))
        found[own] = np.maximum(found[own], _common(strings[own], strings[mate[own]]))
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def _compared(batches):
    got = _columns(batches, ["route", "doc_id", "start", "n", "data"])
    if got is None:
        return
    route, doc, start, n, data = got
    known = data.is_null().to_numpy(zero_copy_only=False) if not isinstance(data, np.ndarray) else np.zeros(0, bool)
    yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(start[known]), pa.array(n[known])], names=["doc_id", "start", "n"])
    rows = np.flatnonzero(~known)
    rows = rows[np.argsort(route[rows], kind="stable")]
    # routes are compared some at a time: all stretches of a route together
    ends = np.flatnonzero(np.append(route[rows][1:] != route[rows][:-1], True)) + 1 if len(rows) else []
    sizes = np.cumsum(n[rows] + WIDTH - 1)
    begin = 0
    while begin < len(rows):
        base = sizes[begin - 1] if begin else 0
        k = int(np.searchsorted(sizes[np.asarray(ends) - 1], base + PART_BYTES, "right"))
        end = int(ends[min(max(k, int(np.searchsorted(ends, begin, "right"))), len(ends) - 1)])
        own = rows[begin:end]
        raw, offsets = text_bytes(data.take(pa.array(own)))
        which = np.repeat(np.arange(len(own)), n[own])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        d, s = doc[own][which], start[own][which] + inner
        copy = longest_previous_factors(raw, offsets[which] + inner, d, s) >= WIDTH
        if copy.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[copy]), pa.array(s[copy].astype(np.int32)), pa.array(np.ones(int(copy.sum()), np.int32))], names=["doc_id", "start", "n"])
        begin = end


def _finished(batches):
    for whole in batches:
        for x in range(0, whole.num_rows, 256):
            batch = whole.slice(x, 256)
            removed, spans, kept = [], [], []
            for text, places in zip(_unpacked(batch), batch.column("places").to_pylist(), strict=True):
                runs = removed_runs(places or [], len(text))
                at, h, n = 0, hashlib.sha256(), 0
                for a, b in runs:
                    h.update(text[at:a])
                    n += b - a
                    at = b
                h.update(text[at:])
                removed.append(n)
                spans.append(runs)
                kept.append(h.hexdigest())
            made = pa.array([[{"start": a, "end": b} for a, b in r] for r in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array([len(r) for r in spans], pa.int64()), pa.array(kept, pa.string()), made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
            )


def removed_runs(places, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the strings that begin at the places."""
    out: list[list[int]] = []
    for a, n in sorted((p["start"], p["n"]) for p in places):
        b = min(size, a + n - 1 + WIDTH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, text: Column | str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (the byte ranges), one row per row."""
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text.alias("text"))
    named = source.where("doc_id IS NOT NULL")

    def anchors(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                row, _, _, anchor, _ = stretches(*text_bytes(batch.column("text").slice(a, b - a)), kinds=False)
                pairs = np.unique(np.stack([row.astype(np.uint64), anchor]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], names=["anchor"])

    # a sample of documents (by hash of the id), of a bounded number, for the choice of routes
    rows = named.count()
    some = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, rows)) * (1 << 20)))
    common = some.mapInArrow(anchors, "anchor long").groupBy("anchor").count().where(F.col("count") >= max(8, int(COMMON * min(rows, SAMPLE)))).orderBy(F.desc("count")).limit(100_000).collect()
    often = np.sort(np.array([r.anchor for r in common], np.int64)).view(np.uint64)

    found = named.mapInArrow(_stretch_rows(often), "route long, anchor long, kind long, kind_low long, doc_id long, start int, n int, state byte")
    met = saved(found.repartition("route").drop("route").mapInArrow(_met, "doc_id long, start int, n int, state byte, anchor long"))
    asked = met.where("state > 1").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "state", "anchor")).alias("places"))
    packed = source.mapInArrow(_packed, "doc_id long, n_bytes long, packed binary")
    data = packed.join(asked, "doc_id").mapInArrow(_asked, "route long, doc_id long, start int, n int, data binary")
    compared = data.repartition("route").mapInArrow(_compared, "doc_id long, start int, n int")
    places = met.where("state = 1").select("doc_id", "start", "n").union(compared).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    return packed.join(places, "doc_id", "left").mapInArrow(_finished, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("removed")
