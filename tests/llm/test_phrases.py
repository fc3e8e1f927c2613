"""Phrase mining against a plain count, and the bound of the summaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crosstide.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], DOCS)


def plain(rows, threshold=10, most=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            taken = any(p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in candidates.items() if len(q) == 3 and len(p) == 2)
            if not taken:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def mined(spark, rows, **kw):
    got = phrases.mine_phrases(docs(spark, rows), **kw).collect()
    assert len(set(map(tuple, got))) == len(got)
    return set(map(tuple, got))


def test_phrases_against_a_plain_count(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["Red", "fox", "the", "ÉTÉ", "été", "x", "a-b", "日本", "of", "in"]
    rows = [(rng.choice(["en", "fr", None, ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", "  ", ", ", "\n", ".", "\x0b", "\x1c"]) for _ in range(rng.randint(0, 60)))) for _ in range(600)]
    rows += [("en", None), ("fr", ""), (None, " . ,\n"), ("de", "one two three " * 9 + "one two"), ("de", "only once")]
    monkeypatch.setattr(phrases, "CHUNK", 700)
    monkeypatch.setattr(phrases, "SEGMENT", 200)
    assert mined(spark, rows) == plain(rows)
    assert {r[0] for r in plain(rows)} >= {"en", "fr", "und", ""}


def test_copies_ties_and_one_language(spark):
    text = "Alpha beta gamma delta, alpha beta gamma; epsilon zeta"
    rows = [("en", text)] * 12 + [("en", "eta theta")] * 10 + [("en", "beta gamma iota")] * 30 + [("en", "kappa " * 5000)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, threshold=25) == plain(rows, 25)
    assert mined(spark, rows, most=2) == plain(rows, most=2)


def test_tables_without_phrases(spark):
    assert mined(spark, [("en", None)]) == set()
    assert mined(spark, [("en", "a b c")]) == set()
    assert phrases.mine_phrases(docs(spark, [("en", "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [2, 10, 33])
def test_summaries_keep_what_is_frequent(threshold):
    rng = np.random.default_rng(threshold)
    drawn = (rng.zipf(1.3, 60_000) % 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes, counts = phrases.folded(drawn, np.ones(len(drawn), np.int64))
    for pieces in (1, 7, 300):
        summary = phrases.Summary(len(drawn), threshold)
        most = 0
        for part in np.array_split(drawn, pieces):
            summary.add(*phrases.unpacked(phrases.packed(*phrases.folded(part, np.ones(len(part), np.int64)))))
            most = max(most, len(summary.hashes))
        kept = summary.survivors()
        assert most <= summary.capacity and summary.lost < threshold
        assert set(hashes[counts >= threshold].tolist()) <= set(kept.tolist())


def test_rounds_of_ranking(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 50)
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"p{i}", (i * 7919) % 1000) for i in range(900)], "lang string, phrase string, score long")
    from pyspark.sql import functions as F

    got = phrases.first_of_each(rows, "lang", [F.desc("score"), F.asc("phrase")], 5).collect()
    for lang in "ab":
        plain_first = sorted((-r.score, r.phrase) for r in rows.collect() if r.lang == lang)[:5]
        assert sorted((r.rank, -r.score, r.phrase) for r in got if r.lang == lang) == [(k, *x) for k, x in enumerate(plain_first, 1)]


def test_rows_and_batches_stay_small(spark):
    rng = random.Random(4)
    long = "".join(rng.choice(["red fox ", "été ", "ran, ", "of.\n"]) + str(rng.randrange(5000)) for _ in range(200_000))
    rows = [("en", long), ("en", "a b. " * 30_000), ("fr", "only once")]
    chunks = docs(spark, rows).coalesce(1).select("lang", "text").mapInArrow(phrases._chunks, "chunk long, lang string, n_words long, body binary").collect()
    assert max(len(r.body) for r in chunks) <= 250_000 < len(long)
    words = lambda text: len(re.findall(rb"[^ \t.,;:!?\n-\r]+", text))
    assert sum(r.n_words for r in chunks) == sum(words(t.encode()) for _, t in rows) == sum(words(r.body) for r in chunks)
    own = [pa.RecordBatch.from_pylist([{"chunk": r.chunk, "lang": r.lang, "body": r.body}]) for r in chunks]
    hashed = list(phrases._hashed(64, 3, True)(own))
    assert len(hashed) > 1 and max(b.nbytes for b in hashed) < 2_000_000
    entries = [(r["chunk"], r["part"]) for b in hashed for r in b.to_pylist() if r["chunk"] >= 0]
    assert len(entries) == len(set(entries))
