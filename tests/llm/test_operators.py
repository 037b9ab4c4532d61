"""The training-data operators against brute force on small tables with nulls, ties, repeated rows, empty and long
texts, and extra columns with clashing names; and on empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvagrid.llm import bpe, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, minhash, mixing, pii, substring_dedup
from silvagrid.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, route long, digest string, size long, component string"
WORDS = "the of and river stone quiet harbour lamp orchard winter letter copper meadow window ladder basket candle thunder".split()


def corpus(n=60, seed=3):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(k))
    out = [text(r.randint(5, 120)) for _ in range(n)]
    out[5] = out[6] = out[7]
    w = out[9].split()
    out[10] = " ".join([*w[:-1], "changed"])
    passage = text(40)
    for i in (12, 13, 14, 15):
        out[i] = f"{text(10)} {passage} {text(8)}"
    out[20], out[21], out[22], out[23] = None, "", " \t\n", "one two"
    out[24] = out[23].upper()
    out[25] = (text(900) + "\n") * 3
    out[26] = "a" * 5000
    line = "a line of some length that is nearly the same"
    out[30], out[31], out[32] = f"{line}\nother words stand here", f"x\n{line}s", f"{line.replace('some', 'same')}\nshort"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4] if i > 25 else "a", 0, "x", 1, 2, "d", 5, "c") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts():
    return {i * 3 + 1: t or "" for i, t in enumerate(corpus())}


def joined(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 150)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = joined(links, {x for p in links for x in p})
    assert all(got.get(i, i) == c for i, c in want.items())


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(docs, digest_bytes):
    got, want = table(exact_dedup.exact_groups(docs, digest_bytes=digest_bytes)), texts()
    groups = collections.defaultdict(list)
    for i, t in want.items():
        groups[t].append(i)
    for i, t in want.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_chunks_depend_on_content_only():
    raw = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8)
    (a,) = exact_dedup.cut_points(raw, np.array([0, len(raw)]))
    both = np.concatenate([raw[:777], raw])
    b = exact_dedup.cut_points(both, np.array([0, 777, len(both)]))[1]
    assert [x + 777 for x in a] == b and a[-1] == len(raw)


def test_substring_dedup(docs):
    got, seen = table(substring_dedup.repeated_spans(docs)), set()
    for i, t in sorted(texts().items()):
        raw = t.encode()
        mark = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                mark[a : a + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())


def test_longest_previous_factors():
    """Against all pairs of suffixes; places of two documents, some of them twice."""
    r = random.Random(3)
    for width, letters in ((8, b"ab"), (12, b"a"), (100, b"abc\0")):
        raw = np.frombuffer(bytes(r.choice(letters) for _ in range(150 + width)), np.uint8)
        at = np.array([r.randrange(150) for _ in range(120)])
        doc, start = at % 2, at // 2
        got = substring_dedup.longest_previous_factors(raw, at, doc, start, width)
        for i, x in enumerate(at):
            want = 0
            for j, y in enumerate(at):
                if (doc[j], start[j]) < (doc[i], start[i]):
                    k = 0
                    while k < width and raw[x + k] == raw[y + k]:
                        k += 1
                    want = max(want, k)
            assert got[i] == want


def test_stretches_cover_every_string_once_and_know_equal_bytes():
    """Also over several parts, and with rows beyond a part."""
    r = random.Random(8)
    shared = bytes(r.choice(b"abcdefgh ") for _ in range(400))
    rows = [bytes(r.choice(b"abcdefgh ") for _ in range(r.choice([0, 50, 99, 100, 101, 300]))) + (shared if i % 3 else b"") for i in range(30)] + [shared * 20, b"", b"a" * 5000]
    raw, offsets = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0] + [len(x) for x in rows])
    for size in (64, 1 << 19):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring_dedup, "PART_BYTES", size)
            row, start, n, anchor, kind = substring_dedup.stretches(raw, offsets)
        strings = [(i, a) for i, s, m in zip(row.tolist(), start.tolist(), n.tolist()) for a in range(s, s + m)]
        assert strings == [(i, a) for i, x in enumerate(rows) for a in range(len(x) - 99)]
        anchors, kinds = {}, {}
        for i, s, m, h, k in zip(row.tolist(), start.tolist(), n.tolist(), anchor.tolist(), map(tuple, kind.tolist())):
            assert kinds.setdefault(k, rows[i][s : s + m + 99]) == rows[i][s : s + m + 99]
            for a in range(s, s + m):
                assert anchors.setdefault(rows[i][a : a + 100], h) == h


@pytest.mark.parametrize("common", [0.01, 2.0])
def test_substring_dedup_of_a_passage_with_many_neighbours(spark, monkeypatch, common):
    """Over 16 partitions, with the passages' anchors in the common list and (above 1) without."""
    r = random.Random(11)
    letters = lambda k: "".join(r.choice("abcdefghij ") for _ in range(k))
    shared = [letters(150) for _ in range(4)]
    rows = [(i, letters(120) + shared[i % 4] + letters(120)) for i in range(64)]
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = table(substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    seen = set()
    for i, t in rows:
        raw = t.encode()
        mark = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                mark[a : a + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(mark), hashlib.sha256(kept).hexdigest())


def test_html():
    page = "<nav><a href=/>Home</a></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>The  river of the\n valley.<br>It is &lt;long&gt;</p><script>x='<p>'</script><p>End</article><div class=comments><p>the first of all</div><footer>(c)</footer>"
    assert html_text.main_text(page) == "A & B\nThe river of the valley. It is <long>\nEnd"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    html_text.main_text("<p>x" * 30_000), html_text.main_text("<" * 50_000), html_text.main_text("<a " + '"' * 50_001)


def test_html_without_article_or_main():
    words = "the river of the valley is in a land that was for it as with his own "
    page = f"<div><h1>A headline</h1><p>{words * 5}</p><p>{words * 4}</p><p>The end.</p></div>"
    assert html_text.main_text(page) == "\n".join(["A headline", (words * 5).strip(), (words * 4).strip(), "The end."])
    menu = "<div><a href=/>Home page of the site</a> <a href=/b>B</a></div>"
    assert html_text.main_text(f"{menu}<p>Not this</p>{menu}{page}").split("\n")[0] != "Not this"
    for text in ("Pitkän joen varrella seisoi vanha talo, jonka ikkunat olivat kiinni. " * 5, "長い川のほとりに古い家があり、その窓は閉じていた。" * 6):
        assert html_text.main_text(f"{menu}<h1>Talo 家</h1><p>{text}</p><p>{text}</p>{menu}") .split("\n")[-2:] == [text.strip()] * 2
    table = "x1 y2 kvark zeta " * 20
    assert table.strip() in html_text.main_text(f"<p>{words * 5}</p><p>{table}</p><p>{words * 5}</p>")


SENTENCE = "The river of the valley was as long as the road that led to it, and there was no other way for those who came from the hills."


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='home has-sidebar'><div><p>{SENTENCE}</p></div></body>",
        f"<div class='content no-comments'><p>{SENTENCE}</p></div>",
        f"<body id=banner><div class='comments'><p>{SENTENCE}</p></div><p>x</p></body>",  # the class of an element with most of the text
        f'<article><p title="5" tall">{SENTENCE}</p></article>',
        f"<article><p title='>' a=\"b>c\" alt=it's>{SENTENCE}</p></article>",
        f"<article><p><a href=/x>{SENTENCE}</a></p></article>",
        f"<article data-class='ad' data-id=nav><p>{SENTENCE}</p><ul class='share social'><li><a href=/>Tell a friend</a></ul><aside>Aside</aside></article>",
        f"<nav class=menu><ul><li><a href=/>Home</a></ul></nav><main><p>{SENTENCE}</main><div class='cookie-banner'>We use cookies</div><div id=comments><p>I read it</div>",
        f"<header>Top</header><p>{SENTENCE}</p><footer>(c)</footer><script>if (a<b) x='</p>'</script><form>Name <input></form>",
    ],
)
def test_html_keeps_the_article_and_no_more(page):
    assert html_text.main_text(page).removesuffix("\nx") == SENTENCE


def test_html_code_between_paragraphs():
    code = "x1 = f(y2); z3 += g(x1, y2); return z3 % 7 if q else None; // " * 2
    words = SENTENCE + " " + SENTENCE
    assert html_text.main_text(f"<p>{words}</p><pre>{code}</pre><p>{words}</p>") == "\n".join([words, code.strip(), words])


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<article><p>Hello</p></article>", "t")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extracted(rows).orderBy("page_id").collect()] == [(1, "", 0), (2, "Hello", 5)]


def base_by_patterns(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in kinds.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if (k == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


def test_pii_base_equals_the_patterns():
    r = random.Random(2)
    for _ in range(4000):
        s = "".join(r.choice("a1b@.@.+1 -()5%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(s) == base_by_patterns(s)


def test_pii_long_digits():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert pii.base_spans("9" * 5000 + ".2.3.4") == []
    assert pii.base_spans("1" * 300_000 + " " + "1.x" * 100_000) == []


def test_pii_field_finds_held_out_spans(spark):
    field = pii.fitted()
    rows = pii.labelled_table(120, 77)
    found = pii.spans_of([t for t, _ in rows], field)
    want = sum(len(s) for _, s in rows)
    assert sum(x in f for (_, s), f in zip(rows, found, strict=True) for x in s) >= 0.85 * want
    assert pii.spans_of(["plain words of a quiet river", ""], field) == [[], []]
    df = spark.createDataFrame([(1, None), (2, "write to a@b.org, now")], "doc_id long, text string")
    got = table(pii.found(df, field))
    assert got[1].spans == "" and got[2].n_email == 1 and got[2].base_sha256 == hashlib.sha256(b"email:9:16").hexdigest()


def codec():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def test_bpe_equals_the_library():
    import tiktoken

    path, pattern = codec()
    c = bpe.Codec.load(path, pattern)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in c.bytes_of.items()}, special_tokens={})
    r = random.Random(1)
    cases = ["".join(r.choice("aeiouthn sé日🙂\n\t1 '") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "ab" * 4000, " " * 999, "é x", "\x1c a\x85b", *[t for t in corpus() if t]]
    ids, at = c.encode_all(cases)
    for k, t in enumerate(cases):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == lib.encode_ordinary(t) and c.decode(own) == t.encode()


def test_bpe_table(docs):
    path, pattern = codec()
    got = table(bpe.encoded_digests(docs, path, pattern, keep=["doc_id"]).select("row.doc_id", "n_tokens", "decoded_sha256"))
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts().items())
    back = bpe.decode_ids(bpe.encode_texts(docs, path, pattern, keep=["doc_id"]), path, pattern).select("row.doc_id", "decoded")
    assert all(bytes(r.decoded) == texts()[r.doc_id].encode() for r in back.collect())


def test_suffix_automaton_parses_into_longest_matches():
    sample = "the cat sat on the mat"
    m = language_id.Model({"x": sample})

    def phrases(t):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k <= len(t) and t[i : i + k] in sample:
                k += 1
            n, i = n + 1, i + max(1, k - 1)
        return n

    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice("thecasonmq ") for _ in range(r.randint(1, 60)))
        codes = np.array([ord(c) for c in t], np.uint32)
        assert int(m.phrases(codes, np.array([len(t)]))[0, 0]) == phrases(t)
    # texts of many windows, side by side, over two languages
    other = "no dog nods on and on and on and on"
    two = language_id.Model({"x": sample, "y": other})
    made = ["".join(r.choice(("thecasonmq ", "no d", sample)[k % 3]) for _ in range(r.choice([0, 1, 511, 512, 513, 3000]))) for k in range(60)] + [other * 40, (sample * 60)[7:], "no d" * 700]
    got = two.phrases(np.array([ord(c) for t in made for c in t], np.uint32), np.array([len(t) for t in made]))
    for t, g in zip(made, got[:, 0].tolist(), strict=True):
        assert g == phrases(t)


def test_pii_spans_over_any_place_of_a_long_line():
    field, r = pii.fitted(), random.Random(4)
    for at in [*range(250, 262), *range(506, 518)]:
        words = [r.choice(WORDS) for _ in range(700)]
        words[at:at] = ["(555)", "123-4567"]
        text = " ".join(words)
        a = text.index("(555)")
        assert pii.spans_of([text], field) == [[("phone", a, a + 14)]], at
    texts = [" ".join(w for t, _ in pii.labelled_table(40, k) for w in t.split()) for k in range(5)]
    t = pii.Tokens(texts)
    e, m, want = field.scores(field.features(t, *t.sequences())), field.step + field.barred, []
    for first, size in zip(*t.sequences(), strict=True):
        score, back = e[first] + m[0], []
        for i in range(first + 1, first + size):
            both = score[:, None] + m
            back.append(both.argmax(0))
            score = both.max(0) + e[i]
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        want += path[::-1]
    assert max(t.sequences()[1]) > 256 and field.decode(t).tolist() == want


def test_language_accuracy_and_cases(spark):
    r = random.Random(8)
    syllables = {"en": "the th ing on er", "de": "sch ung der ein ch"}
    make = lambda k, n: " ".join("".join(r.choice(syllables[k].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, make("en" if i % 2 else "de", 40), "en" if i % 2 else "de") for i in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(i, make("en" if i % 2 else "de", 30)) for i in range(40)] + [(100, None), (101, ""), (102, "123 !!"), (103, make("en", 4000))]
    got = {x.row.doc_id: x for x in language_id.identify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(40)) and got[103].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.predict(["some text"]) == [("und", 0.0)]


def test_language_sample_is_of_distinct_texts_and_filled(spark):
    r = random.Random(9)
    make = lambda a, n: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(n))
    langs = [f"l{i}" for i in range(12)]  # of each, 2,000 rows of 3 distinct texts
    rows = [(t, k) for k in langs for t in [make("abcdefgh", 30) for _ in range(3)] * 667]
    rows += [(make("mnopq", 2), "short") for _ in range(4000)]
    rows += [("in the beginning of all " * 40 + make("uvwxyz", 200), "late")] * 50 + [("12 34", "none")] * 20
    model = language_id._sampled(spark.createDataFrame(rows, "text string, lang string"), [*langs, "late", "none", "short"], 8000, 200)
    assert set(model) == {*langs, "late", "short"}
    assert all(len(model[k]) >= 500 for k in langs)  # three texts of 179 characters
    assert len(model["short"]) == 8000
    whole = language_id._sampled(spark.createDataFrame([("plain words " * 50 + make("uvwxyz", 200), "late") for _ in range(60)], "text string, lang string"), ["late"], 8000, 200)
    two = language_id._sampled(spark.createDataFrame([(make("abcdefgh", 900), "two") for _ in range(2)], "text string, lang string"), ["two"], 8000, 200)
    assert len(two["two"]) == 8000  # two texts of 5,399 characters
    assert sum(c in "uvwxyz" for c in whole["late"]) > 2000


@pytest.mark.parametrize("most", [2048, 24])
def test_embedding_links_near_the_threshold_over_many_lists(spark, monkeypatch, most):
    """500 lists, or 24 with finer ones each; most vectors not in the sample: nearly all links from 0.9 to 0.91 are found."""
    monkeypatch.setattr(embedding_dedup, "LIST_VECTORS", 8)
    monkeypatch.setattr(embedding_dedup, "MOST_LISTS", most)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 1024)
    g = np.random.default_rng(5)
    x = g.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = g.normal(size=x.shape)
    o -= (o * x).sum(1, keepdims=True) * x
    c = g.uniform(0.9, 0.91, (2000, 1))
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * o / np.linalg.norm(o, axis=1, keepdims=True)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = int((u @ u.T >= 0.9).sum()) - len(u)
    assert 0.98 * want <= got <= want, (got, want)


def test_embeddings(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(250, 16))
    near = np.repeat(base[:6], 30, 0) + 0.05 * g.normal(size=(180, 16))
    wide = base[7] + 0.45 * g.normal(size=(60, 16))
    x = np.concatenate([base, near, wide]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, "z") for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0, 2.0]), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + [(i, v, 0, "z") for i, v in odd], "vec_id long, embedding array<float>, label int, part string")
    got = table(embedding_dedup.near_duplicates(df), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    like = u @ u.T >= 0.9
    np.fill_diagonal(like, False)
    n = like.sum(1)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * n.sum()
    assert all(got[i].n_links <= n[i] for i in range(len(x)))
    want = joined(np.argwhere(like).tolist(), range(len(x)))
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths_in_double_precision(spark):
    """Each length among its own; a link that doubles decide (0.9 and a hair less) is not rounded."""
    t = float(np.sqrt(1 - 0.9**2))
    rows = [(1, [1.0, 0.0]), (2, [0.9 + 1e-12, t]), (3, [0.9 - 1e-9, -t]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [1.0] * 4), (7, [1e300, 0.0]), (8, [0.0, 1e-300, 0.0])]
    got = table(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (2, 1), 8: (0, 8)}


def test_line_dedup(docs):
    got = table(line_dedup.deduplicated(docs))
    first, want = {}, {}
    for i, t in sorted(texts().items()):
        for j, line in enumerate(t.split("\n")):
            if len(line) >= line_dedup.MIN_CHARS:
                first.setdefault(line, (i, j))
    gone = {a for a in first for b in first if first[b] < first[a] and line_dedup.within_one(a, b)}
    for i, t in texts().items():
        want[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if len(x) < line_dedup.MIN_CHARS or (first[x] == (i, j) and x not in gone))
    assert gone and all(got[i].kept_sha256 == hashlib.sha256(w.encode()).hexdigest() for i, w in want.items())


def test_equal_short_lines_go(spark):
    texts = ["yes\n\n一行短句。\nno", "一行短句。\nYes\n\nyes", "noo\nno\nno\n"]
    got = table(line_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert [(got[i].kept_text, got[i].n_removed) for i in range(3)] == [(texts[0], 0), ("Yes\n", 2), ("noo\n", 2)]


def removed_lines(texts, least):
    first = {}
    for i, t in sorted(texts.items()):
        for j, line in enumerate(t.split("\n")):
            if line:
                first.setdefault(line, (i, j))
    long = [x for x in first if len(x) >= least]
    gone = {a for a in long for b in long if first[b] < first[a] and line_dedup.within_one(a, b)}
    return {i: [j for j, x in enumerate(t.split("\n")) if x and (first[x] != (i, j) or x in gone)] for i, t in texts.items()}


@pytest.mark.parametrize("clash", [False, True])
def test_lines_of_two_letters(spark, monkeypatch, clash):
    """Short lines over two letters, where nearly all have neighbours; once with keys so short that they meet by chance."""
    r = random.Random(6)
    given = {i: "\n".join("".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(6)) for i in range(120)}
    if clash:
        whole = line_dedup.keys_of
        monkeypatch.setattr(line_dedup, "_neighbourhood", _clashing(whole))
    got = table(line_dedup.deduplicated(spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3), least=3))
    want = removed_lines(given, 3)
    assert all(got[i].n_removed == len(w) for i, w in want.items())
    assert all(got[i].kept_text == "\n".join(x for j, x in enumerate(given[i].split("\n")) if j not in w) for i, w in want.items())


def _clashing(keys_of):
    def run(batches):
        line_dedup.keys_of = lambda line, wanted: ((k := keys_of(line, wanted))[0] % np.uint64(7), k[1])
        try:
            yield from plain(batches)
        finally:
            line_dedup.keys_of = keys_of

    plain = line_dedup._neighbourhood
    return run


def test_line_families(spark):
    """A common line with a character replaced or put in anywhere, and ids that are text."""
    r = random.Random(12)
    base = "this is a common line of forty characters"
    lines = []
    for _ in range(150):
        i, c = r.randrange(len(base)), r.choice("xyzé長")
        lines.append(r.choice([base[:i] + c + base[i + 1 :], base[:i] + c + base[i:], base[:i] + base[i + 1 :], base]))
    given = {f"d{i:03}": "\n".join(lines[i * 3 : i * 3 + 3]) for i in range(50)}
    got = table(line_dedup.deduplicated(spark.createDataFrame(list(given.items()), "doc_id string, text string")))
    want = removed_lines(given, line_dedup.MIN_CHARS)
    assert sum(map(len, want.values())) > 100 and all(got[i].n_removed == len(w) for i, w in want.items())
    near = table(line_dedup.deduplicated(spark.createDataFrame([(None, base), (None, base), ("a", base + "x\n" + base)], "doc_id string, text string")))
    assert near["a"].kept_text == "" and near[None].n_removed == 0


def test_mixing(docs):
    got = table(mixing.mix_counts(docs))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts().items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    per = {n: sum(size[i] for i in size if source[i] == n) for n in names}
    goal = dict(zip(names, mixing.targets(list(per.values()), [3.0, 1.0, 2.0, 3.0], 1.5, 2.0), strict=True))
    for n in names:
        own = [got[i] for i in size if source[i] == n]
        assert abs(sum(r.taken for r in own) - goal[n]) <= 1
        assert all(r.source_size == per[n] and abs(r.target - goal[n]) < 1e-6 and r.taken <= 2 * r.size and r.size == size[r.doc_id] for r in own)
    again = table(mixing.mix_counts(docs.repartition(5)))
    assert all(got[i].taken == again[i].taken for i in size)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        keys = mixing._keys(1, 2, 3)
        p = mixing.permuted(np.arange(n), n, keys)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, n, keys, inverse=True) == np.arange(n)).all()


def test_mixed_documents_hold_what_was_counted(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    counts = table(mixing.mix_counts(plain))
    n = collections.Counter()
    for r in mixing.mix_documents(plain).collect():
        n[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert all(n[i] == r.taken for i, r in counts.items())


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "one two three four five " * 30, "a")] * 4 + [(1, "one two three four five " * 30, "b"), (None, "x y z", "a"), (None, "x y z", "a"), (2, "", "a"), (3, None, None), (4, "words of the other source " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = mixing.mix_counts(df).collect()
    assert len(counts) == len(rows) and all(r.taken <= 2 * r.size for r in counts)
    n = collections.Counter()
    for r in mixing.mix_documents(df).collect():
        n[r.doc_id, r.source] += len(r.text.split())
    assert n["", ""] == 0 and sum(n.values()) == sum(r.taken for r in counts)
    assert n[1, "b"] == 271 and n[1, "a"] + n[None, "a"] == sum(r.taken for r in counts if r.source_size == 606)


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(3)
    for c, rest, n in ((3 * 10**9, 10**9, 40_000), (10**12, 3, 10**11), (2 * 10**9, 2 * 10**9, 3 * 10**9)):
        got = np.array([mixing._drawn(rng, c, rest, n) for _ in range(400)], float)
        p = c / (c + rest)
        sd = (n * p * (1 - p) * (c + rest - n) / (c + rest - 1)) ** 0.5
        assert abs(got.mean() - n * p) < 5 * sd / 20 and 0.85 * sd <= got.std() <= 1.15 * sd and got.max() <= min(c, n)
    # the quotient of probabilities, against exact logarithms of factorials
    lg = lambda c, k: sum(np.log1p(-np.arange(k) / c))
    assert all(abs(mixing._fallen(c, k) - lg(c, k)) < 1e-6 for c, k in ((2 * 10**6, 1000), (10**9, 50_000), (10**5, 7)))


def shingled(texts, width):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return sets


def near_pairs(sets, percent):
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, width, percent):
    sets = shingled(texts(), width)
    pairs = near_pairs(sets, percent)
    want = joined(pairs, sets)
    got = table(minhash.near_duplicates(docs, width=width, percent=percent))
    assert pairs and all((got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i) for i in sets)


def families(seed=8):
    """Groups of texts with more and more words changed, so that lists hold many components; ids in no order."""
    r = random.Random(seed)
    out = []
    for size in (150, 60, 30):
        base = [r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(size)]
        for _ in range(70):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
                w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
            out.append(" ".join(w[: len(w) - r.choice([0, 0, 0, 3, 12])]))
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_dedup_of_families(spark, width, percent):
    given = families()
    sets = shingled(given, width)
    want = joined(near_pairs(sets, percent), sets)
    got = table(minhash.near_duplicates(spark.createDataFrame(list(given.items()), "doc_id long, text string"), width=width, percent=percent))
    assert len(set(want.values())) > 60 and {i: got[i].component_id for i in sets} == want


def test_near_dedup_exact_step_alone(spark):
    """Without any link from the stars, the join on shingles finds all."""
    given = families(9)
    sets = shingled(given, 3)
    pairs = near_pairs(sets, 85)
    source = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    join = minhash._Join(source, 3, 85, minhash.MATCHES)
    got, _ = join._rest(spark.createDataFrame([], "id long, component long"))
    first = {hash(frozenset(s)): i for i, s in sorted(sets.items(), reverse=True)}  # one text of each class is in the join
    wanted = {(a, b) for a, b in pairs if first[hash(frozenset(sets[a]))] == a and first[hash(frozenset(sets[b]))] == b}
    assert wanted and wanted <= {(r.u, r.v) for r in got.collect()}


def test_bitmaps_differ_no_more_than_sets():
    g = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(g.integers(0, 1 << 63, int(g.integers(1, 900)), dtype=np.uint64))
        y = np.union1d(x[g.random(len(x)) < g.random()], g.integers(0, 1 << 63, int(g.integers(0, 200)), dtype=np.uint64))
        apart = sum(int(w).bit_count() for w in (minhash.bitmap(x) ^ minhash.bitmap(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y))


def test_near_dedup_repeated_ids_and_other_types(spark):
    w = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [("k", " ".join(w)), ("k", "quite another text of more words than five"), ("b", " ".join(w)), ("z", "quite another text of more words than five"), (None, " ".join(w)), ("y", None), ("x", " ".join(w[:3]))]
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()]
    assert sorted(got, key=str) == sorted([("k", 22, "b", False), ("k", 4, "b", False), ("b", 22, "b", True), ("z", 4, "b", False), (None, 22, None, True), ("y", 0, "y", True), ("x", 1, "x", True)], key=str)


def test_empty_tables(nothing, spark):
    path, pattern = codec()
    plain = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for out in (exact_dedup.exact_groups(nothing), substring_dedup.repeated_spans(nothing), line_dedup.deduplicated(nothing), mixing.mix_counts(nothing), mixing.mix_documents(plain), minhash.near_duplicates(nothing), pii.found(nothing, pii.Field()), bpe.encoded_digests(nothing, path, pattern)):
        assert out.count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same words in this text of mine"), (1, "same words in this text of mine"), (None, "other words altogether here now"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert exact_dedup.exact_groups(df).count() == 4
    assert minhash.near_duplicates(df).count() == 4
    assert substring_dedup.repeated_spans(df).where("n_removed = 0").count() == 4
    assert line_dedup.deduplicated(df).count() == 4
    assert mixing.mix_counts(df).count() == 4
