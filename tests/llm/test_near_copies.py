"""Large groups of near copies: the work follows the copies, whatever their ids are."""

import random

import pytest

from crosstide.llm import jaccard_join


@pytest.mark.parametrize("ids", ["hashed", "in order"])
def test_work_follows_the_copies(spark, monkeypatch, ids):
    made = {}
    remaining = jaccard_join.remaining

    def counted(named, points, percent):
        pairs = remaining(named, points, percent)
        made["rows"] = pairs.count()
        return pairs

    monkeypatch.setattr(jaccard_join, "remaining", counted)
    for copies in (100, 300):
        rng = random.Random(3)
        text = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        rows = [(" ".join(text), 0)]
        for k in range(copies):
            near = list(text)
            for at in rng.sample(range(200), 4):
                near[at] = f"z{k}x{at}"
            rows.append((" ".join(near), k + 1))
        name = "xxhash64(n)" if ids == "hashed" else "n"
        docs = spark.createDataFrame(rows, "text string, n long").selectExpr(f"{name} as doc_id", "text")
        groups = {r.component_id for r in jaccard_join.similar_documents(docs).collect()}
        assert len(groups) == 1
        assert made["rows"] <= copies


def test_repeated_rows_of_a_node_are_verified_once(spark, monkeypatch):
    seen = []
    verified = jaccard_join.verified

    def counted(pairs, sets, percent):
        seen.append((pairs.count(), sets.count(), sets.select("node").distinct().count()))
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    one = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, one)] * 30 + [(2, one + " end")] * 30, "doc_id long, text string")
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == 60 and {r.component_id for r in got} == {1}
    assert seen[0] == (1, 2, 2)
