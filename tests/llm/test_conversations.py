"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from crosstide.llm import conversations

TABLE = "conv_id long, turn long, role string, text string, seg long, fault string"
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], TABLE)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's damaged rows to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        inked = text.strip(SPACES)
        faults.append("b" if not inked else "d" if (role, text) in seen else "t" if inked[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    follows = {"S": {"s": "P", "u": "U"}, "P": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    n = len(rows)

    @cache
    def best(i, state, inserts):
        """Least (cost, edits, lines) from here on; at most three inserts in a row."""
        found = [(0, "", ())] if i == n and state in "SA" else []

        def go(cost, edit, line, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1], line + rest[2]))

        if inserts < 3:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if initial in follows[state]:
                    go(2, "I", (f"{role}:",), best(i, follows[state][initial], inserts + 1))
        if i < n:
            _, _, role, text = rows[i]
            go(3, "D", (), best(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                late = faults[i] == "t"
                if role[:1] in follows[state]:
                    go(late, "K", (f"{role}:{text}",), best(i + 1, follows[state][role[:1]], 0))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    if initial in follows[state]:
                        go(2 + late, "R", (f"{other}:{text}",), best(i + 1, follows[state][initial], 0))
        return min(found, default=None)

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for state in follows:
            best(i, state, 0)
    cost, audit, lines = best(0, "S", 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    left = plain_damage(rows)
    return {c: plain_repair([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def repaired(spark, rows):
    got = conversations.repair_conversations(table(spark, rows)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def drawn(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "u", "tool", "", None, "student"]
    texts = ["One two.", "Why?", "no end", "  ", "", None, "Ends!\n", "wörter. \t", "a.b", "\x1c", "x\ny.", " "]
    out = []
    for k in range(n):
        role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles)
        text = f"text {k}." if rng.random() < 0.6 else rng.choice(texts)
        turn = k + 2 * (rng.random() < 0.1) if rng.random() < 0.9 else rng.choice([None, 0, -3])
        out.append((conv, turn, role, text))
        if rng.random() < 0.1:
            out.append(out[-1])
    return out


def test_short_conversations(spark):
    rng = random.Random(8)
    rows = [r for conv in [None, *range(160)] for r in drawn(rng, conv, rng.randint(1, 12))]
    rows += [(900, None, None, None), (901, 2**62, "user", "a."), (901, -(2**61), "assistant", "b.")]
    rng.shuffle(rows)
    assert repaired(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows_of_a_segment", [1, 3])
def test_conversations_over_many_segments(spark, monkeypatch, rows_of_a_segment):
    monkeypatch.setattr(conversations, "ROWS", rows_of_a_segment)
    rng = random.Random(rows_of_a_segment)
    rows = [r for conv in [None, 5, 6, 7, 8, 9, 10] for r in drawn(rng, conv, rng.choice([1, 2, 9, 40]))]
    assert repaired(spark, rows) == plain(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, 0, "user", "same.")] * 500 + [(1, 1, "assistant", "same.")] * 300 + [(1, 2, "assistant", " ")] * 40 + [(1, 3, "assistant", "last")]
    rows += [(2, k, "user", "again.") for k in range(60)] + [(3, 0, "user", "word " * 200_000), (3, 1, "assistant", "yes.")]
    assert repaired(spark, rows) == plain(rows)


def test_empty_tables_and_nothing_left(spark):
    assert repaired(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_ranks_order_the_edits_to_come():
    rng = random.Random(1)
    n = 30
    initials = [[rng.choice("usa") for _ in range(rng.randint(1, 9))] for _ in range(n)]
    faults = [[rng.choice([0, 0, 1, 2, 3]) for _ in x] for x in initials]
    graph = conversations.Graph(initials, faults, [[1] * len(x) for x in initials], np.ones(n, bool))
    graph.solve(np.tile(conversations.END, (n, 1)))
    edits = {}
    for node in graph.ids[graph.costs < conversations.NEVER].tolist():
        way, at = "", node
        while graph.pointers[0][at] != at:
            way += conversations.EDITS[graph.edit[at]] if graph.edit[at] < 4 else ""
            at = graph.pointers[0][at]
        edits[node] = way
    real = [v for v in edits if v // 4 % (graph.longest + 1) < graph.rows[v // 4 // (graph.longest + 1)]]
    for s in real:
        for t in rng.sample(real, 20):
            assert (edits[s] < edits[t]) == (graph.rank[s] < graph.rank[t])
