"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

Base spans (e-mail addresses, IP addresses, card numbers, phone numbers) are the leftmost non-overlapping
matches of fixed patterns that pass their checks. They always stay. The field adds spans: what the patterns
miss, such as phone numbers without a country code, and secrets (access keys, passwords). Its tokens are the
runs of characters between white space; its features are a token's shape (letters, capitals, digits and signs,
runs collapsed), its length, its number of digits, and its neighbours' shapes. It is trained on the driver
from a small labelled table (at most ``most_rows`` rows, by default the one built in here), by gradient ascent
on the conditional log-likelihood. Viterbi decodes many sequences at a time in numpy; a sequence is a line, cut
only behind tokens that are outside on every best path, which changes no result. An added span that overlaps a base span or an added one before it is dropped, and
one of a kind that has a check (a card number, an address) must pass it.

Cases: a null text counts as empty and has no spans. Repeated rows each give a row; extra columns are ignored;
an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SHAPES, LENGTHS, DIGITS = 4096, 48, 24

# The patterns of the contract; those that begin with a run of one class can't begin inside that run, which
# keeps long runs linear: had a match begun there, it would have begun at the run's start.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a local part ends at an @ and reaches back as far as its characters go."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            after = m.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", after)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    """At most 255, with any number of zeros before it."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed in BASE, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def labelled_table(rows: int = 240, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Short lines with their spans, made from fixed templates. Every name and number in them is invented."""
    r = random.Random(seed)
    low, hexa, up = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    word = lambda: "".join(r.choice(low) for _ in range(r.randint(1, 11)))
    some = lambda s, a, b: "".join(r.choice(s) for _ in range(r.randint(a, b)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = "4" + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    makers = {
        "email": [lambda: f"{word()}.{num(2)}@{word()}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}_{word()}@{word()}{num(1)}.net"],
        "ip": [lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))],
        "card": [card, lambda: re.sub(r"(.{4})(?=.)", r"\1 ", card()), lambda: re.sub(r"(.{4})(?=.)", r"\1-", card())],
        "phone": [lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"{num(3)}-{num(3)}-{num(4)}"],
        "secret": [lambda: "AKIA" + some(up, 16, 16), lambda: "password=" + some(hexa, 14, 20), lambda: f'"{some(hexa, 40, 40)}"', lambda: "api_key=" + some(hexa, 24, 32), lambda: "token:" + some(hexa, 32, 40)],
    }
    plain = [
        lambda: str(r.randint(1, 40)) + ".", lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1, 9)},{num(3)}", lambda: f"{num(2)}%",
        lambda: word().upper() + "!!", lambda: word() + r.choice(["***", "$$$", "###", "%%%", "&&&"]), lambda: word() + "-" + word(), lambda: f"({word()})", lambda: f'"{word()}"', lambda: f"v{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{num(2)}:{num(2)}", lambda: f"http://{word()}.example.org/{word()}", lambda: word() + "=" + word(), lambda: num(5), lambda: f"{num(2)}-{num(2)}", lambda: word().capitalize() + num(1), lambda: "é" + word() + "ñ", lambda: word().upper(),
    ]
    out = []
    for _ in range(rows):
        parts, spans, at = [], [], 0

        def add(s: str, kind: str | None = None) -> None:
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(s)))
            s += r.choice(["", "", "", "", ".", ","])  # noqa: B023
            parts.append(s)
            at += len(s) + 1

        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 6)):
                add(word().capitalize() if r.random() < 0.15 else word())
            if r.random() < 0.5:
                add(r.choice(plain)())
            if r.random() < 0.75:
                kind = r.choice(KINDS)
                add(r.choice(makers[kind])(), kind)
        add(word())
        out.append((" ".join(parts), spans))
    return out


def _classes() -> np.ndarray:
    out = np.full(0x3000, 1, np.uint8)  # letters of no other class
    for i in range(0x3000):
        c = chr(i)
        if c.isspace():
            out[i] = 0
        elif c.isupper():
            out[i] = 2
        elif "0" <= c <= "9":
            out[i] = 3
        elif not c.isalpha():
            out[i] = 4 + (i if i < 128 else 1)
    return out


_CLASS = _classes()
_POWER = np.array([pow(1_000_003, k, 1 << 32) for k in range(24)], np.uint64)


class Tokens:
    """Tokens of texts laid end to end, as numpy columns, with their features."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _CLASS[np.minimum(codes, len(_CLASS) - 1)]
        solid = cls != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.base = np.cumsum(lengths) - lengths
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        n = len(self.start)
        lines = np.cumsum(codes == 10) if len(codes) else np.zeros(0, np.int64)
        self.line = lines[self.start] if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), self.end - self.start)
        kind = cls[solid]
        first = np.ones(len(kind), bool)
        if len(kind):
            first[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        who, what = owner[first], kind[first].astype(np.uint64)
        begin = np.searchsorted(who, np.arange(n))
        place = np.minimum(np.arange(len(who)) - begin[who], 23)
        h = np.zeros(n, np.uint64)
        if n:
            h = np.add.reduceat(what * _POWER[place], begin)
        with np.errstate(over="ignore"):
            self.shape = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int32)
        self.length = np.minimum(self.end - self.start, LENGTHS - 1).astype(np.int32)
        self.digits = np.minimum(np.bincount(owner[kind == 3], minlength=n), DIGITS - 1).astype(np.int32)
        self.joined = joined

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """(first token, number of tokens) of each line."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], self.line[1:] != self.line[:-1]]))
        return first, np.diff(np.append(first, n))


def _near(column: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column one token before and after, in its sequence; SHAPES where there is none."""
    before, after = np.full(len(column), SHAPES, np.int32), np.full(len(column), SHAPES, np.int32)
    before[1:], after[:-1] = column[:-1], column[1:]
    before[first], after[first + size - 1] = SHAPES, SHAPES
    return before, after


class Field:
    """Labels: 0 outside; 1 + 2k begins kind k, 2 + 2k goes on with it."""

    labels = 1 + 2 * len(KINDS)

    def __init__(self):
        L = self.labels
        self.w = {"shape": np.zeros((SHAPES, L)), "length": np.zeros((LENGTHS, L)), "digits": np.zeros((DIGITS, L)), "before": np.zeros((SHAPES + 1, L)), "after": np.zeros((SHAPES + 1, L)), "bias": np.zeros((1, L))}
        self.step = np.zeros((L, L))
        self.barred = np.zeros((L, L))
        for k in range(len(KINDS)):  # going on needs a beginning
            self.barred[:, 2 + 2 * k] = -1e4
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0

    def features(self, t: Tokens, first, size) -> dict[str, np.ndarray]:
        before, after = _near(t.shape, first, size)
        return {"shape": t.shape, "length": t.length, "digits": t.digits, "before": before, "after": after, "bias": np.zeros(len(t.shape), np.int32)}

    def scores(self, features) -> np.ndarray:
        out = None
        for k, v in features.items():
            part = self.w[k].take(v, axis=0)
            out = part if out is None else np.add(out, part, out=out)
        return out

    def fit(self, rows, rounds: int = 120, rate: float = 0.25, shrink: float = 0.02) -> Field:
        """Full-batch gradient ascent with momentum-scaled steps (Adam) on the conditional log-likelihood."""
        t = Tokens([text for text, _ in rows])
        gold = np.zeros(len(t.start), np.int64)
        for d, (_, spans) in enumerate(rows):
            for kind, a, b in spans:
                own = np.flatnonzero((t.doc == d) & (t.start - t.base[d] < b) & (t.end - t.base[d] > a))
                gold[own] = 2 + 2 * KINDS.index(kind)
                gold[own[:1]] = 1 + 2 * KINDS.index(kind)
        first, size = t.sequences()
        feats = self.features(t, first, size)
        mean, square = {}, {}
        params = {**self.w, "step": self.step}
        L, T = self.labels, int(size.max())
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = [int(np.searchsorted(-size, -i, "left")) for i in range(T)]
        prev_gold, next_gold = gold[:-1], gold[1:]
        inner = np.ones(len(gold) - 1, bool)
        inner[first[first > 0] - 1] = False
        pairs = np.zeros((L, L))
        np.add.at(pairs, (prev_gold[inner], next_gold[inner]), 1)
        for i in range(1, rounds + 1):
            e, m = self.scores(feats), self.step + self.barred
            em = np.exp(m)
            alpha, beta = np.zeros((T, len(first), L)), np.zeros((T, len(first), L))
            alpha[0] = e[first]
            for s in range(1, T):
                n = live[s]
                top = alpha[s - 1, :n].max(1, keepdims=True)
                alpha[s, :n] = e[first[:n] + s] + top + np.log(np.exp(alpha[s - 1, :n] - top) @ em + 1e-300)
            for s in range(T - 2, -1, -1):
                n = live[s + 1]
                x = beta[s + 1, :n] + e[first[:n] + s + 1]
                top = x.max(1, keepdims=True)
                beta[s, :n] = top + np.log(np.exp(x - top) @ em.T + 1e-300)
            z = alpha[0] + beta[0]
            top = z.max(1, keepdims=True)
            logz = (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0]
            p = np.zeros_like(e)
            moves = np.zeros((L, L))
            for s in range(T):
                n = live[s]
                p[first[:n] + s] = np.exp(alpha[s, :n] + beta[s, :n] - logz[:n, None])
                if s + 1 < T and live[s + 1]:
                    n = live[s + 1]
                    x = e[first[:n] + s + 1] + beta[s + 1, :n]
                    moves += np.exp(alpha[s, :n, :, None] + m[None] + x[:, None, :] - logz[:n, None, None]).sum(0)
            p[np.arange(len(gold)), gold] -= 1
            grads = {"step": moves - pairs}
            for k, v in feats.items():
                g = np.zeros_like(self.w[k])
                np.add.at(g, v, p)
                grads[k] = g
            for k, w in params.items():
                g = grads[k] + shrink * w
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
                w -= rate * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-8)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.step = self.step.astype(np.float32)
        return self

    def decode(self, t: Tokens) -> np.ndarray:
        """The most likely label of each token; all sequences step together."""
        first, size = t.sequences()
        out = np.zeros(len(t.start), np.int8)
        if not len(first):
            return out
        e = self.scores(self.features(t, first, size))
        m = (self.step + self.barred).astype(np.float32)
        # A sequence whose tokens all score highest as "outside", by more than any path could win back over the
        # steps beside it, is outside as a whole; only the others need the search.
        most, least = float(m.max()), float(m[0, 0])
        lead = e[:, 0] - e[:, 1:].max(1)
        # Were a token's label changed to "outside", and that of the next from going on to beginning, three steps and
        # these two scores would change: beyond that lead the token is outside, and what follows begins after it.
        again = np.append((e[1:, 2::2] - e[1:, 1::2]).max(1), 0)
        sure = lead > 3 * float(self.step.max() - self.step.min()) + np.maximum(again, 0) + 1e-2
        starts = np.zeros(len(e) + 1, bool)
        starts[first] = True
        starts[1:] |= sure
        first = np.flatnonzero(starts[:-1])
        size = np.diff(np.append(first, len(e)))
        plain = np.minimum.reduceat(lead, first) > 2 * (most - least)
        first, size = first[~plain], size[~plain]
        if not len(first):
            return out
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        T = int(size[0])
        live = np.searchsorted(-size, -np.arange(T), "left")
        back = []
        score = e[first] + m[0][None]  # as after an outside token
        for s in range(1, T):
            n = live[s]
            both = score[:n, :, None] + m[None]
            back.append(both.argmax(1).astype(np.int8))
            score[:n] = both.max(1) + e[first[:n] + s]
        label = score.argmax(1).astype(np.int8)
        for s in range(T - 1, -1, -1):
            n = live[s]
            if s + 1 < T:
                k = live[s + 1]
                label[:k] = back[s][np.arange(k), label[:k]]
            out[first[:n] + s] = label[:n]
        return out


_TRIM = re.compile(r"^[\"'“”‘’\[<{«,;:.!?]+|[\"'“”‘’\]>}»,;:.!?]+$")


def spans_of(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: base ones first, by kind and start, then the added ones by kind and start."""
    t = Tokens(texts)
    labels = field.decode(t)
    added: dict[int, list[tuple[str, int, int]]] = {}
    hits = np.flatnonzero(labels)
    run: list[int] | None = None
    for i in [*hits.tolist(), -1]:
        if run and i >= 0 and labels[i] == run[2] and labels[i] % 2 == 0 and i == run[1] + 1:
            run[1] = i
            continue
        if run:
            d = int(t.doc[run[0]])
            a, b = int(t.start[run[0]] - t.base[d]), int(t.end[run[1]] - t.base[d])
            added.setdefault(d, []).append((KINDS[(run[2] - 1) // 2], a, b))
        run = [i, i, int(labels[i]) + int(labels[i] % 2)] if i >= 0 else None
    out = []
    for d, text in enumerate(texts):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        more = []
        for kind, a, b in added.get(d, []):
            piece = text[a:b]
            left = len(piece) - len(_TRIM.sub("", piece, count=1)) if _TRIM.match(piece) else 0
            a += left
            piece = _TRIM.sub("", text[a:b])
            b = a + len(piece)
            if not piece or any(x < b and a < y for x, y in taken) or not _passes(kind, piece):
                continue
            more.append((kind, a, b))
            taken.append((a, b))
        out.append(base + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def _passes(kind: str, piece: str) -> bool:
    d = _digits(piece)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 7 <= len(d) <= 15
    if kind == "ip":
        return len(p := piece.split(".")) == 4 and all(x.isdecimal() and len(x) < 4 and int(x) < 256 for x in p)
    if kind == "email":
        return "@" in piece.strip("@") and "." in piece
    return len(piece) >= 12 and (bool(d) or piece.isupper())


def fitted(labelled: list[tuple[str, list[tuple[str, int, int]]]] | None = None, most_rows: int = 2000) -> Field:
    return Field().fit((labelled or labelled_table())[:most_rows])


def found(docs: DataFrame, field: Field, text: Column | str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end, base>>, and the digest columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    text = F.col(text) if isinstance(text, str) else text
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        f = shipped.value
        for batch in batches:
            for a, b in slices(batch.column("text"), 2 << 20):
                part = batch.slice(a, b - a)
                texts = [x or "" for x in part.column("text").to_pylist()]
                rows = spans_of(texts, f)
                base = [[s for s in base_spans(x)] if r else [] for x, r in zip(texts, rows, strict=True)]
                say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE]
                ordered = [sorted(r, key=lambda s: (KINDS.index(s[0]), s[1])) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([hashlib.sha256(say(r).encode()).hexdigest() for r in base], pa.string()), pa.array([say(r) for r in ordered], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), fitted())
