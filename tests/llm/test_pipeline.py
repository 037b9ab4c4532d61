"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from silvagrid.llm import bpe, mixing
from silvagrid.llm.common import saved
from tests.llm.test_operators import corpus, joined


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "source_mixing", "byte_bpe"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen.append((docs.collect(), spark.read.parquet(str(tmp_path / name))))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    before, after = seen[0]
    assert ids(after) == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text or ""))
    before, after = seen[1]
    last = {}
    for r in before:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert ids(after) == sorted(last.values())
    before, after = seen[2]
    sets = {r.doc_id: shingles(r.text) for r in before}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert ids(after) == sorted(i for i, c in joined(pairs, sets).items() if i == c)
    before, after = seen[3]
    text = {r.doc_id: r.text for r in before}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in text.items()}
    got = dict.fromkeys(words, 0)
    for r in after.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert all(piece in text[r.doc_id] for piece in r.text.split("\n")) and r.n_chars == len(r.text)
    assert all(got[i] <= 2 * n for i, n in words.items()) and sum(got.values()) > 0
    before, after = seen[4]
    codec = bpe.Codec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    rows = after.collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in rows) == want
    assert all(hashlib.sha256(codec.decode(r.ids)).hexdigest() == r.decoded_sha256 and len(r.ids) == r.n_tokens for r in rows)
    assert after.select(F.sum("n_tokens")).first()[0] > 0


def test_rows_without_or_with_equal_ids(spark, tmp_path):
    """Null ids, repeated rows and one id over two texts, through run()."""
    words = lambda a: " ".join(f"{w}{a}" for w in "river stone quiet harbour lamp orchard winter letter copper meadow window ladder".split())
    near = " ".join(words(k) for k in "abcd")
    rows = [(None, words("e")), (None, words("f")), (1, words("g")), (1, words("g")), (2, words("h")), (2, words("i")), (3, words("h")), (4, near), (5, near + " more"), (5, words("j"))]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_copies(spark, table, str(tmp_path))
    pairs = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    want = [(i or 0, t) for i, t in dict.fromkeys(rows) if (i, t) != (2, words("h"))]
    assert pairs(kept) == sorted(want)
    kept = corpus_pipeline.drop_near_copies(spark, saved(kept), str(tmp_path))
    want.remove((5, near + " more"))
    assert pairs(kept) == sorted(want)
    kept = saved(kept)
    counts = {(r.doc_id or 0, r.size): r.taken for r in mixing.mix_counts(kept).where("doc_id IS NULL").collect()}
    assert all(counts.values())
    mixed, size = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        mixed.setdefault(r.doc_id or 0, []).append(codec().decode(r.ids).decode())
    texts = {i: [t for j, t in want if j == i] for i, _ in want}
    assert set(mixed) == set(texts)
    # share 1.5: half as many words again as there are; no text more than twice
    assert sum(size(t) for got in mixed.values() for t in got) == round(1.5 * sum(size(t) for _, t in want))
    for i, got in mixed.items():
        assert len(got) <= 2 * len(texts[i]) and all(any(p in t for t in texts[i]) for g in got for p in g.split("\n"))
        assert all(any(size(g) <= size(t) and g.split("\n")[0] in t for t in texts[i]) for g in got)


def codec():
    return bpe.Codec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
