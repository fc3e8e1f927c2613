"""Toxicity against a plain count of n-grams and on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from crosstide.llm import toxicity
from crosstide.llm.common import flat

DOCS = "doc_id long, text string, lang string, label int, share double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 9, 9.0) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, toxic int, quality int, text string")


def plain_ngrams(text):
    return {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


def test_ngrams_are_those_of_characters():
    texts = ["", None, "a", "éàb éàb", "x" * 50, "日本語 text", "ab"]
    data, offsets = flat(pa.array(texts))
    seen = [set() for _ in texts]
    for hashes, text in toxicity.ngrams(data, offsets):
        assert (np.diff(text) >= 0).all()
        for h, t in zip(hashes.tolist(), text.tolist(), strict=True):
            seen[t].add(h)
    plain = [plain_ngrams(t or "") for t in texts]
    assert [len(s) for s in seen] == [len(s) for s in plain]
    assert len(set().union(*seen)) == len(set().union(*plain))


def test_counts_and_ratios(spark):
    rng = random.Random(3)
    rows = [(k % 3 == 0, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40))) + ("vile" if k % 3 == 0 else "")) for k in range(60)]
    ones, zeros = Counter(), Counter()
    for one, text in rows:
        (ones if one else zeros).update(plain_ngrams(text))
    grams, ratios = toxicity.features(spark.createDataFrame([(int(a), t) for a, t in rows], "label int, text string"))
    kept = {g for g in set(ones) | set(zeros) if ones[g] + zeros[g] >= toxicity.LEAST}
    assert len(grams) == len(kept) <= toxicity.FEATURES
    p, q = sum(1 + ones[g] for g in kept), sum(1 + zeros[g] for g in kept)
    plain = sorted(math.log((1 + ones[g]) / p) - math.log((1 + zeros[g]) / q) for g in kept)
    assert np.allclose(np.sort(ratios), plain)


def test_learns_from_the_taught_fold_only(spark):
    rng = random.Random(5)
    parts = ["ka", "lo", "mi", "tu", "ne", "sa"]

    def prose(n):
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows, marks = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = prose(rng.randint(20, 60)) + (f" Grob{rng.choice(parts)} " + prose(5) if bad else "")
        held = zlib.crc32(str(i).encode()) % 3 == 1
        rows.append((i, text))
        marks.append((i, int(bad) if not held else int(not bad)))  # wrong labels in the held-out fold teach nothing
    truth = {i: "Grob" in t for i, t in rows}
    odd = [(900, None), (901, ""), (902, "!"), (903, (prose(20_000) + " grobka")), (None, rows[0][1]), (3, rows[3][1])]
    marks += [(901, None), (None, 1), (5, marks[5][1])]
    got = toxicity.score_toxicity(docs(spark, rows + odd), labels(spark, marks)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    asked = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by_id[i].held_out for i in asked) and not by_id[None].held_out
    assert sum(by_id[i].predicted == truth[i] for i in asked) >= 0.97 * len(asked)
    assert by_id[900].score == by_id[901].score == by_id[902].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_no_usable_labels_and_empty_tables(spark):
    table = docs(spark, [(1, "some text"), (2, None)])
    for marks in ([], [(1, 0), (2, 0)], [(7, 1), (8, 0)]):
        got = toxicity.score_toxicity(table, labels(spark, marks)).collect()
        assert len(got) == 2 and len({r.score for r in got}) == 1
    assert toxicity.score_toxicity(table.limit(0), labels(spark, [(1, 1)])).collect() == []
    assert toxicity.score_toxicity(table, labels(spark, [(1, 1), (2, 0)]), sample=1).count() == 2


def test_tasks_hold_few_counts_and_send_small_batches(monkeypatch):
    monkeypatch.setattr(toxicity, "_KEPT", 2000)
    monkeypatch.setattr(toxicity, "_TEXT", 1000, raising=False)
    rng = random.Random(7)
    rows = [(i % 2, "".join(rng.choice("abcdefghijklmnopé ") for _ in range(rng.randint(0, 300)))) for i in range(400)]
    ones, zeros = Counter(), Counter()
    for one, text in rows:
        (ones if one else zeros).update(plain_ngrams(text))
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([t for _, t in own])], names=["label", "text"]) for own in (rows[i : i + 20] for i in range(0, 400, 20))]
    taken, counted, early = [], Counter(), 0
    for got in toxicity._count(taken.append(b) or b for b in batches):
        early += len(taken) < 10
        for r in got.to_pylist():
            counted[r["gram"]] += (r["ones"] << 32) + r["zeros"]
    assert early > 2  # counts leave the task long before its last text
    assert sorted(counted.values()) == sorted((ones[g] << 32) + zeros[g] for g in set(ones) | set(zeros))
    grams = np.array(list(counted), np.int64).view(np.uint64)[:3000]
    described = list(toxicity._describe(grams, np.ones(len(grams)))(pa.RecordBatch.from_arrays([b.column(0), b.column(0), b.column(1)], names=["label", "share", "text"]) for b in batches))
    assert [k for b in described for k in b.column(0).to_pylist()] == [k for k, _ in rows]
    assert len(described) > len(batches) and max(b.num_rows for b in described) < 20
