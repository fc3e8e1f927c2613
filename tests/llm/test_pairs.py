"""N-gram join, suffix dedup and neighbours against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crosstide.llm import jaccard_join, neighbours, suffix_dedup

DOCS = "doc_id long, text string, source string, node long, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], DOCS)


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(n)]


def plain_join(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_join_finds_every_link(spark):
    rng = random.Random(4)
    rows = []
    passage = words(rng, 60)
    for base in range(10):
        text = words(rng, rng.choice([3, 5, 9, 30, 68, 90, 150, 400, 900]))
        for _ in range(rng.randint(1, 6)):
            near = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                near[rng.randrange(len(near))] = "zz" + str(rng.randint(0, 10**6))
            rows.append((rng.randint(0, 10**6), " ".join(near).upper() if rng.random() < 0.3 else " ".join(near)))
        rows.append((rng.randint(0, 10**6), " ".join(words(rng, 30) + passage + words(rng, 30 * base + 1))))
    rows += [(2_000_000, None), (2_000_001, ""), (2_000_002, " \t\n"), (2_000_003, "one two"), (2_000_004, "ONE  two"), (2_000_005, "two one")]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs(spark, rows)).collect()}
    assert got == plain_join(rows)


def test_join_of_odd_tables(spark):
    assert jaccard_join.similar_documents(docs(spark, [])).collect() == []
    text = "a b c d e f g"
    got = jaccard_join.similar_documents(docs(spark, [(7, text), (7, text), (None, text), (3, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 3, -1), (3, 3, 3), (7, 3, 3), (7, 3, 3)]


def test_tree_keeps_every_pair_that_reaches_the_bound():
    rng = np.random.default_rng(3)
    base = rng.poisson(3.0, (30, jaccard_join.DIMS))
    points = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1)) for _ in range(8)]).astype(np.uint16)
    sizes = points.sum(1, dtype=np.int64)
    a, b = jaccard_join.survivors(points[:100], sizes[:100], points[100:], sizes[100:])
    bound = np.minimum(points[:100, None], points[None, 100:]).sum(2, dtype=np.int64)
    need = jaccard_join.needed(sizes[:100, None], sizes[None, 100:])
    fits = (bound >= need) & (np.minimum(sizes[:100, None], sizes[None, 100:]) >= need)
    assert set(zip(*(x.tolist() for x in np.nonzero(fits)), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) and (bound[a, b] >= need[a, b]).all()


def plain_removal(rows, span):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + span] for b in raw for s in range(len(b) - span + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        covered = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if seen[b[s : s + span]] > 1:
                covered[s : s + span] = b"\1" * span
        runs = sum(covered[j] and not (j and covered[j - 1]) for j in range(len(b)))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [None, 700])
def test_removal_of_repeats(spark, monkeypatch, slices):
    if slices:  # every text is cut into overlapping slices
        monkeypatch.setattr(suffix_dedup, "SLICE", slices)
        monkeypatch.setattr("crosstide.llm.suffix_dedup.pieces", lambda d, o: ((i, d[o[i] : o[i + 1]], o[i : i + 2] - o[i]) for i in range(len(o) - 1)))
    rng = random.Random(8)
    parts = [" ".join(words(rng, 250)) for _ in range(4)]
    rows = []
    for i in range(40):
        text = " ".join(words(rng, rng.randint(0, 120)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(parts)
            at = rng.randrange(len(p))
            text += p[at : at + rng.choice([150, 399, 400, 401, 655, 900])] + rng.choice(["", "é", " new words here"])
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "b" * 401), (103, "xyz" * 300), (104, "ab" * 200), (105, rows[3][1]), (105, rows[3][1]), (None, rows[4][1])]
    rows += [(106, parts[0][:400]), (107, "q" + parts[0][:399])]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs(spark, rows)).where("doc_id is not null").collect())
    assert got == [r for r in plain_removal(rows, 400) if r[0] is not None] or sorted(got, key=repr) == [r for r in plain_removal(rows, 400) if r[0] is not None]
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    values = rng.standard_normal((900, 24))
    values[100:400] = values[100]  # ties
    values[500:] *= rng.uniform(0.2, 3.0, (400, 1))  # lengths differ
    rows = [(i, v.tolist(), 5) for i, v in enumerate(values)]
    rows += [(1000, None, 5), (1001, [0.0] * 24, 5), (1002, [float("nan")] * 24, 5), (1003, [None] * 24, 5), (1004, [float("inf")] * 24, 5), (None, [1.0] * 24, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    from pyspark.sql import functions as F

    got: dict = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        products = (values * values[q]).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(900), -products)) if i != q][:20]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and q not in dict(found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(products[i] - s) < 1e-12 for i, s in found)
    assert hits >= 0.9 * 20 * len(got)
    tied = [i for i, _ in got[120] if 100 <= i < 400]
    assert len(tied) > 3 and tied == [i for i in range(100, 400) if i != 120][: len(tied)]
    few = neighbours.search(table.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.search(table.where("vec_id >= 1000"), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_of_batches_without_queries(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "small_batches", lambda spark, rows: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    values = np.random.default_rng(5).standard_normal((61, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    best = {q: [int(i) for i in np.argsort(-(values @ values[q]), kind="stable") if i != q][:5] for q in (0, 20, 40, 60)}
    assert [(r.query_id, r.vec_id) for r in got] == [(q, i) for q, found in best.items() for i in found]
    assert neighbours.rotate(np.zeros((0, 64)), 3).shape == (0, 64)


def test_neighbours_move_vectors_once(spark):
    import os

    from pyspark.sql import functions as F

    def shuffled():
        stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f"{stored.apply(i)}" for i in range(stored.size()) if stored.apply(i).getName().startswith("shuffle_")}

    values = np.random.default_rng(6).standard_normal((4000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>")
    before = shuffled()
    found = neighbours.search(table, F.col("vec_id") % 20 == 0)
    assert found.count() == 200 * 20
    assert sum(os.path.getsize(f) for f in shuffled() - before) < 5 * values.nbytes


def test_nearest_of_blocks_equals_plain_products(monkeypatch):
    rng = np.random.default_rng(7)
    values = rng.standard_normal((1500, 16)) * rng.uniform(1e-3, 50, (1500, 1))
    values[200:700], values[700:900] = values[200], values[201] * 1.0000001
    ids = rng.permutation(5000)[:1500].astype(np.int64)
    asked, everywhere = np.arange(0, 1500, 7), np.full((1500, neighbours.TABLES * 2 * neighbours.AXES // 8), 255, np.uint8)
    cells = rng.integers(0, 2 * neighbours.AXES, (1500, neighbours.TABLES)).astype(np.uint8)
    cells[:, 3:] = 5
    monkeypatch.setattr(neighbours, "AT_ONCE", 50)
    monkeypatch.setattr(neighbours, "PRODUCTS", 900)
    monkeypatch.setattr(neighbours, "CHOSEN", 700)
    for kind in ("f8", "f4"):
        v = values.astype(kind)
        q, found, score = neighbours.nearest(v[asked], ids[asked], everywhere[asked], v, ids, cells, 9)
        for a in asked:
            products = (v.astype(float) * v[a].astype(float)).sum(1)
            best = [i for i in np.lexsort((ids, -products)) if i != a][:9]
            assert found[q == ids[a]].tolist() == ids[best].tolist() and score[q == ids[a]].tolist() == products[best].tolist()


def test_hadamard_rotation_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 64))
    assert np.allclose(np.linalg.norm(neighbours.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert neighbours.matrix(pa.array([[1.0], [2.0, 3.0]]), 3).tolist() == [[1, 0, 0], [2, 3, 0]]


def test_removal_leaves_no_shuffle_files_behind(spark):
    def shuffled():
        stored = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f"{stored.apply(i)}" for i in range(stored.size()) if stored.apply(i).getName().startswith("shuffle_")}

    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(900))
    rows = [(i, shared[: 500 + 40 * i] + "".join(rng.choice("ghijk ") for _ in range(600))) for i in range(8)]
    before = shuffled()
    left = suffix_dedup.remove_repeats(docs(spark, rows))
    assert not shuffled() - before
    assert left.where("n_removed = 0").count() == 0
