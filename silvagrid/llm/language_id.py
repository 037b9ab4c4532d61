"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its labelled text. A text is parsed
against it into phrases, each the longest match that occurs anywhere in the sample; the fewer phrases a text
needs, the closer it is to the language. Phrase counts are normalised by what a phrase costs, the logarithm
of the sample's length, so samples of different length compare. The language with the least cost wins.

The parse is a walk: follow the automaton while it can, else count a phrase and begin again at the root with
the same character. "Can't follow" is folded into one table (the root's own step, with a count), so one step is
one lookup, and numpy takes the steps of thousands of windows and of all languages at once. Texts are parsed in
windows of WINDOW characters so that long texts become many lanes; a window goes on where the one before it ends, so
the phrases are those of the whole text.

Sampling bound: ``sample_chars`` characters a language at most (fewer if the languages' tables would exceed
``table_bytes`` together), in pieces at hashed places of the distinct labelled texts, in the order of a hash of the
text, until that many characters are there or all texts are. Prediction sees all rows and whole texts.

Cases: a null text, or one without letters, is ``und`` with score 0. Ties go to the alphabetically first
language. Without any labelled row everything is ``und``. Labels that are null are not learned. Characters
that no sample has count as a phrase of their own in every language. Repeated rows are each predicted; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm.common import slices, small_batches, table

WINDOW, SAMPLE_CHARS, TABLE_BYTES = 512, 32_000, 256 << 20
_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """By code point: its small letter, or a blank if it is no letter. Made once a process."""
    if not _LOWER:
        out = np.full(0x110000, 32, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                out[ord(c)] = ord(c.lower()[0])
        _LOWER.append(out)
    return _LOWER[0]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end and their lengths: small letters, and one blank for each run of
    anything else."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = _lower()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(lengths)
    keep = codes != 32
    if len(keep):
        keep[1:] |= codes[:-1] != 32
        starts = (ends - lengths)[lengths > 0]
        keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[ends] - kept[ends - lengths]


def normalised(text: str) -> str:
    return folded([text])[0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def automaton(text: str, classes: dict[str, int]) -> np.ndarray:
    """The step table of the suffix automaton, by [state, class]: next state * 4 + the phrases that end. One ends
    where the walk begins again; a character that the sample lacks ends a phrase of its own as well. Class 0 is
    any character that is in no sample."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        c = classes[ch]
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    wide = max(classes.values(), default=0) + 1
    again = np.full(wide, 2, np.int32)
    for c, s in nxt[0].items():
        again[c] = 4 * s + 1
    out = np.tile(again, (len(nxt), 1))
    out[0] = 1  # at the root no phrase is open
    for s, step in enumerate(nxt):
        for c, to in step.items():
            out[s, c] = 4 * to
    return out


class Model:
    """Tables of all languages, one below the other; built on the driver from the bounded sample."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s})
        classes = {c: i + 1 for i, c in enumerate(letters)}
        self.lookup = np.zeros(max((ord(c) for c in letters), default=0) + 2, np.int32)  # its last entry: unknown
        for c, i in classes.items():
            self.lookup[ord(c)] = i
        self.wide = len(letters) + 1
        tables = [automaton(samples[k], classes) for k in self.langs]
        starts = np.cumsum([0] + [len(t) for t in tables])
        # an entry holds the place of the next state's row in the joint table, and the phrases
        self.table = np.concatenate([(((t >> 2) + a) * self.wide) * 4 + (t & 3) for t, a in zip(tables, starts.tolist(), strict=False)]).reshape(-1).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.roots = (starts[:-1] * self.wide).astype(np.int32)
        self.cost = np.array([np.log2(max(2, len(samples[k]))) for k in self.langs])

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases by [text, language]. Windows are first walked from the root, all at once; then each but a text's first
        is walked again from the state in which the one before it ends, as far as the two walks differ."""
        n_texts = len(lengths)
        cls = self.lookup[np.minimum(codes, len(self.lookup) - 1)]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        lanes = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(n_texts), lanes)
        first = np.concatenate([[0], np.cumsum(lanes)])[:-1]
        place = (np.arange(len(owner)) - first[owner]) * WINDOW
        begin, size = starts[owner] + place, np.minimum(WINDOW, lengths[owner] - place)
        order = np.argsort(-size, kind="stable")
        state = np.repeat(self.roots[:, None], len(owner), 1)
        count = np.zeros(state.shape, np.int32)
        lives = np.searchsorted(-size[order], -np.arange(WINDOW), "left")  # windows longer than t
        at_begin = begin[order]
        for t in range(WINDOW):
            live = lives[t]
            if not live:
                break
            at = state[:, :live]
            at += cls[at_begin[:live] + t]
            step = self.table.take(at)
            count[:, :live] += step & 3
            np.right_shift(step, 2, out=at)
        back = np.argsort(order)
        state, count = state[:, back], count[:, back]
        self._resume(cls, begin, size, place > 0, state, count)
        out = np.zeros((n_texts, len(self.langs)))
        last = place + size == lengths[owner]
        count += (state != self.roots[:, None]) & last  # a text's end ends the open phrase
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, count[j], n_texts)
        return out

    def _resume(self, cls, begin, size, later, state, count) -> None:
        """Mends the windows' end states and counts, which were taken from the root, for the states they really begin in."""
        came = np.repeat(self.roots[:, None], state.shape[1], 1)  # what each window's walk began with
        alone, lone_count = state.copy(), count.copy()
        while True:
            true = came.copy()
            true[:, 1:] = np.where(later[1:], state[:, :-1], came[:, 1:])
            lang, lane = np.nonzero(true != came)
            if not len(lane):
                return
            came[lang, lane] = true[lang, lane]
            one, two, at, end = self.roots[lang].copy(), true[lang, lane], begin[lane].copy(), begin[lane] + size[lane]
            # until shown otherwise, the walk from the root is met
            state[lang, lane], count[lang, lane] = alone[lang, lane], lone_count[lang, lane]
            while len(lane):
                a, b = self.table.take(one + cls[at]), self.table.take(two + cls[at])
                count[lang, lane] += (b & 3) - (a & 3)
                one, two, at = a >> 2, b >> 2, at + 1
                over = (at == end) & (one != two)
                state[lang[over], lane[over]] = two[over]
                on = (one != two) & (at < end)
                lang, lane, one, two, at, end = lang[on], lane[on], one[on], two[on], at[on], end[on]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        codes, size = folded(texts)
        letters = np.concatenate([[0], np.cumsum(codes != 32)])
        ends = np.cumsum(size)
        has = letters[ends] > letters[ends - size]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        n = self.phrases(codes, size)
        bits = n * self.cost / np.maximum(size, 1)[:, None]  # of a character
        best = bits.argmin(1)
        # the winner's share when each language weighs 2 ** -(bits of 16 characters)
        share = 1 / np.exp2(-16 * (bits - bits.min(1, keepdims=True))).sum(1)
        return [(self.langs[b], float(p)) if h else ("und", 0.0) for b, p, h in zip(best.tolist(), share.tolist(), has.tolist(), strict=True)]


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, table_bytes: int = TABLE_BYTES) -> Model:
    """labelled: text, lang. What reaches the driver is bounded: sample_chars of each language, languages as
    many as there are labels, and all of them together within what table_bytes allows."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model({})
    each = max(1000, min(sample_chars, table_bytes // (len(langs) * 4 * 64 * 2)))
    with small_batches(rows.sparkSession):
        return Model(_sampled(rows, langs, each, max(200, each // 40)))


def _letters(batches):
    """lang, hash and the number of characters of each normalised text, once a batch; texts without letters go."""
    for batch in batches:
        for a, b in slices(batch.column("text"), 2 << 20):
            part = batch.slice(a, b - a)
            codes, size = folded(part.column("text").to_pylist())
            ends = np.cumsum(size)
            letters = np.concatenate([[0], np.cumsum(codes != 32)])
            has = letters[ends] > letters[ends - size]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(size)], names=["lang", "h", "n"]).filter(pa.array(has))


def _pieces(most: dict[str, int]):
    """Of each text at most so many characters as its language takes, from a place that its hash says."""

    def run(batches):
        for batch in batches:
            made = []
            for k, t, at in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "at")), strict=True):
                t, piece = normalised(t).strip(), most[k]
                x = at % max(1, len(t) - piece + 1)
                made.append(t[x : x + piece])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(made, pa.string())], names=["lang", "h", "t"])

    return run


def _sampled(rows: DataFrame, langs: list[str], each: int, piece: int) -> dict[str, str]:
    """Pieces of each language's distinct texts, those with the smallest hashes, until ``each`` characters. The cut
    by hash is set from the characters of distinct texts, so each task keeps about as many as are needed; it is
    raised for a language whose sample comes out short, and then the pieces grow, until it is filled or has all there is."""
    h = F.xxhash64("text")
    keyed = rows.select("lang", "text", h.alias("h"), F.xxhash64("text", F.lit(1)).alias("at"))
    unit = F.pmod(F.col("h"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    kept = keyed.select("lang", "text", "h").mapInArrow(_letters, "lang string, h long, n long").groupBy("lang", "h").agg(F.max("n").alias("n"))
    per = kept.groupBy("lang").agg(F.sum(F.least("n", F.lit(piece)) + 1).alias("chars"), F.max("n").alias("longest")).collect()
    share, longest, most = {r.lang: min(1.0, 3 * each / r.chars) for r in per}, {r.lang: r.longest for r in per}, {r.lang: piece for r in per}
    made, todo = {}, sorted(share)
    while todo:
        cut = F.create_map(*[F.lit(x) for k in todo for x in (k, share[k])])
        some = keyed.where(F.col("lang").isin(todo)).where(unit < cut[F.col("lang")]).mapInArrow(_pieces({k: most[k] for k in todo}), "lang string, h long, t string").where("t <> ''").distinct()
        out = {k: [] for k in todo}
        for r in sorted(some.collect(), key=lambda r: (r.lang, r.h & ((1 << 30) - 1), r.h, r.t)):
            out[r.lang].append(r.t)
        for k, texts in out.items():
            made[k] = " ".join(texts)[:each]
        todo = [k for k in todo if len(made[k]) < each and (share[k] < 1 or most[k] < min(each, longest[k]))]
        for k in todo:
            if share[k] < 1:
                share[k] = min(1.0, 4 * share[k])
            else:
                most[k] = min(each, 4 * most[k])
    return {k: v for k, v in made.items() if v.strip()}


def identify(docs: DataFrame, model: Model, text: Column | str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred and score."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    within = text if isinstance(text, str) and text in keep else None  # a text that is kept comes once, in its row
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *([] if within else [text.alias("text")]))

    def run(batches):
        m = shipped.value
        for batch in batches:
            texts = batch.column("row").field(within) if within else batch.column("text")
            for a, b in slices(texts, 1 << 20):
                part = batch.slice(a, b - a)
                got = m.predict([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["row", "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, model, keep=["doc_id"]).select("row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
