"""Operators on single texts against plain versions, held-out accuracy and round trips."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crosstide.llm import decontaminate, language, mixing, pii, quality, token_files, url_filter

DOCS = "doc_id long, text string, lang string, source string, size int"


def docs(spark, rows, lang=None, source="s"):
    return spark.createDataFrame([(i, t, lang, source, 1) for i, t in rows], DOCS)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def invented(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    kinds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["é", "eau", "oi", "ç"]}
    rows = [(i, (lang := rng.choice(list(kinds))), invented(rng, kinds[lang], rng.randint(20, 80))) for i in range(300)]
    odd = [(900, "aa", None), (901, "aa", ""), (902, "aa", "123 --- 4"), (903, None, rows[0][2]), (904, None, "x" * 300_000), (None, "aa", rows[0][2])]
    table = spark.createDataFrame([(i, t, lang, "s", 1) for i, lang, t in rows + odd], DOCS)
    got = {r.doc_id: r for r in language.identify_languages(table).collect()}
    asked = [(i, lang) for i, lang, _ in rows if held_out(i)]
    assert sum(got[i].lang_pred == lang for i, lang in asked) >= 0.95 * len(asked)
    assert all(got[i].held_out == held_out(i) for i, _, _ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == rows[0][1] and got[904].rejected and got[904].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_languages(table.limit(0)).collect() == []
    assert {r.lang_pred for r in language.identify_languages(docs(spark, [(1, "some words")])).collect()} == {"und"}


def plain_spans(text):
    def luhn(d):
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["4111 1111 1111 1111", " 4012888888881881 ", "1.2.3.4", "255.0.0.256", "007.8.9.10", "a@b.c", "%q@r.st-u.v", "+1 (234) 555-0100", "@", "..", "é𝒳", "+12345678", " ", "9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))) for i in range(150)]
    rows += [(1000 + i, "".join(rng.choice("é19. @+-()ab") for _ in range(rng.randint(0, 200)))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, "1" * 30_000 + "a@b.c" + "x." * 30_000), (2003, "a@b.c " * 500)]
    got = {r.doc_id: r for r in pii.personal_data_digest(docs(spark, rows)).collect()}
    for i, text in rows:
        base = plain_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        assert got[i].spans.startswith(joined)


def test_added_personal_data_needs_checks_or_context(spark):
    rows = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32 here"),
        (2, "GB82 WEST 1234 5698 7654 33"),
        (3, "ssn 123-45-6789"),
        (4, "part 123-45-6789"),
        (5, "token = " + "a1" * 20),
    ]
    got = {r.doc_id: r.spans for r in pii.personal_data_digest(docs(spark, rows)).collect()}
    assert got == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: "secret:8:48"}
    full = {r.doc_id: r.spans for r in pii.find_personal_data(docs(spark, [(1, "mail to x@y.z"), (2, "see x@y.z")])).collect()}
    assert full[1][0].score > full[2][0].score and full[1][0].text == "x@y.z"


def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.25
        text = invented(rng, ["th", "er", "in", "on", "es"], rng.randint(20, 120))
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), " ".join(w for w in text.split()[:4] for _ in range(20))])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 9))
    rows += [(1000, None), (1001, ""), (1002, "word " * 100_000), (None, rows[0][1]), (5, rows[5][1])]
    labels += [(None, 1, 9), (1000, None, 9), (6, labels[6][1], 9)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, size int")
    got = quality.score_quality(docs(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    asked = [(i, q) for i, q, _ in labels[:400] if held_out(i)]
    assert sum(by_id[i].predicted == q for i, q in asked) >= 0.95 * len(asked)
    assert by_id[1002].predicted == 0
    none = quality.score_quality(docs(spark, rows[:5]), table.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs(spark, []), table).collect() == []


def test_rules_of_a_tree():
    printed = "\n".join(["Model", "  If (feature 0 <= 1.5)", "   If (feature 2 > 0.25)", "    Predict: 0.0", "   Else (feature 2 <= 0.25)", "    Predict: 1.0", "  Else (feature 0 > 1.5)", "   Predict: 1.0"])
    assert quality.paths(printed) == {((0, "<=", 1.5),), ((0, "<=", 1.5), (2, ">", 0.25)), ((0, "<=", 1.5), (2, "<=", 0.25)), ((0, ">", 1.5),)}


def test_statistics_by_hand():
    row = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["Aa bb bb | c1!", None, ""]))[0], strict=True))
    assert row["n_words"] == 5 and row["repeated_words"] == 1 / 5 and row["bars"] == 1 / 5
    assert row["upper"] == 1 / 7 and row["distinct_words"] == 4 / 5 and row["commonest_word"] == 2 / 5
    assert not quality.statistics(pa.array([None, ""])).any()


def test_urls(spark):
    rng = random.Random(4)
    hosts = ["news.org", "spam.net", "a.example.net", "b.example.com", "www.ORG", "net", "xnet"]
    urls = [rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(["/en/", "/de/", "/fr/", "/", "", "?q", "/fr"]) + rng.choice(["", "x1", "#y", "?a=/en/"]) for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://u@H.Net:80/é?x", "http://net\n/en/"]
    table = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0])
        assert got[i].verdict == rule[1] if rule[1] else got[i].verdict in ("allow", "block")
    assert url_filter.judge_urls(table.limit(0)).collect() == []
    unruled = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).collect()
    assert [(r.verdict, r.score) for r in unruled] == [("allow", 0.0)]


def test_threshold_parts_two_heaps():
    bins = {(0, 100): 50, (0, 900): 1, (1, 1500): 40, (1, 1600): 2}
    cut = url_filter.threshold(bins)
    assert url_filter.REACH * (2 * 900 / url_filter.BINS - 1) < cut <= url_filter.REACH * (2 * 1500 / url_filter.BINS - 1)
    assert url_filter.threshold({(1, 3): 5}) == 0.0


def plain_mix(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] >= 2 * total[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    return size, total, target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 300), rng.choice(["b", "a", "é", "B", None, "a"])) for i in range(600)]
    rows += [(1000, None, "b"), (1001, "", "empty"), (1002, "v " * 50_000, "long")]
    table = spark.createDataFrame([(i, t, "en", s, 3) for i, t, s in rows], DOCS)
    got = {r.doc_id: r for r in mixing.mix_sources(table).collect()}
    size, total, target = plain_mix(rows)
    for i, _, s in rows:
        assert got[i].size == size[i] and got[i].source_size == total[s] and math.isclose(got[i].target, target[s], abs_tol=1e-6)
        assert got[i].taken <= 2 * size[i]
    for s in total:
        taken = sum(got[i].taken for i, _, x in rows if x == s)
        assert abs(taken - target[s]) <= max([size[i] for i, _, x in rows if x == s])
    again = {r.doc_id: r.taken for r in mixing.mix_sources(table.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix_sources(table.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "a b", "en", "x", 3)] * 3 + [(None, "c", "en", "x", 3)], DOCS)
    assert mixing.mix_sources(same).count() == 4


def plain_copies(rows):
    """{id: (p, copies)} by sorting each source whole."""
    size, total, target = plain_mix(rows)
    out = {}
    for s in total:
        own = [(i, t or "") for i, t, x in rows if x == s]
        mean = total[s] // len(own)
        place = {i: math.floor(10_000 * size[i] / (size[i] + mean)) if size[i] else 0 for i, _ in own}
        middle = sum(size[i] * place[i] for i, _ in own) / total[s] if total[s] else 0
        share = target[s] / total[s] if total[s] else 0.0
        certain = math.floor(share)
        q, rest = share - certain, target[s] - certain * total[s]
        order = []
        for i, t in own:
            digest = hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 2**52
            p = q * (1 + (1 - q) * (place[i] - middle) / 20_000) if q > 0 else 0.0
            order.append((u / (1 - u) / (p / (1 - p)) if p else 0.0, u, i, p))
        before = 0
        for _, _, i, p in sorted(order):
            out[i] = p, certain + (p > 0 and before + size[i] / 2 <= rest)
            before += size[i]
    return out


def test_mixing_by_unequal_odds(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 40, 300]), rng.choice(["b", "a", "c", "c", None])) for i in range(3000)]
    rows += [(5000, None, "b"), (5001, "v " * 30_000, "c")]
    table = spark.createDataFrame([(i, t, "en", s, 3) for i, t, s in rows], DOCS)
    monkeypatch.setattr(mixing, "GROUP", 3)
    monkeypatch.setattr(mixing, "CELL", 20)
    got = {r.doc_id: r for r in mixing.mix_sources(table).collect()}
    wanted = plain_copies(rows)
    assert {i: r.copies for i, r in got.items()} == {i: c for i, (_, c) in wanted.items()}
    assert all(math.isclose(got[i].p, p, abs_tol=1e-9) for i, (p, _) in wanted.items())
    drawn = {s: [r for r in got.values() if r.source == s and r.p > 0] for s in ("a", "b", "c", None)}
    open_sources = [s for s, found in drawn.items() if found]
    assert open_sources
    for s in open_sources:
        assert len({round(r.p, 9) for r in drawn[s]}) > 3
        rest = drawn[s][0].target % drawn[s][0].source_size
        assert math.isclose(sum(r.p * r.size for r in drawn[s]), rest, rel_tol=1e-6)


def test_mixing_rows_without_ids_and_repeats(spark):
    rows = [(None, f"w {k}", "en", "x", 3) for k in range(40)] + [(7, "a b c", "en", "x", 3)] * 30 + [(None, None, "en", None, 3)] * 3
    clash = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "p"}).selectExpr("*", "1 as u", "2 as cell", "3 as target")
    got = mixing.mix_sources(clash).collect()
    assert len(got) == 73 and sum(r.size for r in got) == 40 * 2 + 30 * 3
    assert abs(sum(r.taken for r in got) - 1.5 * 170) <= 3


@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


TEXTS = ["Hello there, it's  two  spaces", "line\nbreaks\n\nand tabs\t.", "", None, "trailing ", " leading", "a b  c", "<|endoftext|> in <|endoftext|>", "é𝒳 naïve", "word " * 3000, "\n", "x\n", "one two\nthree four, five."]


def test_encoder_equals_the_library(vocabulary):
    coder = token_files.Encoder(vocabulary)
    for _ in range(2):
        for text, ids in zip(TEXTS, coder.encode(TEXTS), strict=True):
            assert ids == (coder.ids(text).tobytes() if text else b"")


def test_token_files_round_trip(spark, vocabulary, tmp_path):
    rows = [(k * 7, t) for k, t in enumerate(TEXTS)] + [(7, "again")]
    folder = f"file://{tmp_path}/ids"
    got = token_files.token_documents(docs(spark, rows), vocabulary, 0, folder).collect()
    coder, start, want = token_files.Encoder(vocabulary), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = (coder.ids(t).tolist() if t else []) + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in rows)
    assert token_files.token_documents(docs(spark, []), vocabulary, 0, folder + "-none").collect() == []


def test_shard_reads_only_what_is_asked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 40)
    path = tmp_path / "one.ids"
    ids = {i: np.arange(i * 3, dtype="<u4").tobytes() for i in range(9)}
    with pa.OSFile(str(path), "wb") as out:
        writer = token_files.ShardWriter(out)
        for i, raw in ids.items():
            writer.add(i, raw)
        writer.close()
    with pa.OSFile(str(path)) as source:
        reader, read = token_files.ShardReader(source), []
        whole = reader.frame
        reader.frame = lambda i: read.append(i) or whole(i)
        assert [(i, raw) for i, _, raw in reader.documents({4, 8})] == [(4, ids[4]), (8, ids[8])]
        assert len(read) == 2 < len(reader.frames)
        assert {i: raw for i, _, raw in reader.documents()} == ids
    import zstandard

    with open(path, "rb") as raw:  # a plain decompressor reads all frames
        assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(ids.values())
    broken = bytearray(path.read_bytes())
    broken[-30] ^= 1
    path.write_bytes(broken)
    with pa.OSFile(str(path)) as source, pytest.raises(Exception):
        list(token_files.ShardReader(source).documents())


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        masks: dict = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.common_subsequence(masks, len(a), b) == plain_subsequence(a, b)


def test_decontamination(spark):
    rng = random.Random(7)
    common = ["the", "of", "and"]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.4 else "w" + str(rng.randint(0, 30_000)) for _ in range(n)]

    items = [(k, prose(rng.choice([14, 25, 40, 60, 150]))) for k in range(12)]
    rows, want = [], set()
    for i in range(160):
        body = prose(rng.randint(0, 500))
        if i % 4 == 0:
            k, words = rng.choice(items)
            words = list(words)
            if i % 8 == 0:  # a paraphrase: some words go, some come
                for _ in range(len(words) // 8):
                    words[rng.randrange(len(words))] = "other" + str(rng.randint(0, 999))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," for w in words]
            want.add((i, k))
        rows.append((i, " ".join(body)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(prose(60_000)))]
    table = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(50, None, "x"), (51, "", "x"), (None, "w1 w2", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    assert len(want - got) <= 0.05 * len(want) and not {i for i, _ in got - want}
    assert {(i, k) for i, k in want if i % 8} <= got
    assert decontaminate.contaminated(docs(spark, rows), table.limit(0)).collect() == []
    assert decontaminate.contaminated(docs(spark, []), table).collect() == []


def test_decontamination_of_copies_in_a_third_of_the_rows(spark):
    rng = random.Random(17)

    def prose(n):
        return ["w" + str(rng.randint(0, 30_000)) for _ in range(n)]

    item, leaked, short = prose(36), prose(120), ["the", "of", "and", "the"]
    rows = [(i, " ".join(prose(100) + (leaked[:60] + item + leaked[60:] if i % 3 == 0 else ["the"] * 40) + prose(100))) for i in range(90)]
    rows.append((500, " ".join(prose(50) + short + prose(50))))
    table = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    assert {(i, 1) for i in range(0, 90, 3)} == {x for x in got if x[1] == 1}
    assert (500, 2) in got


def test_decontamination_by_the_end_of_a_long_item(spark):
    """Only the last 96 of 116 words are copied: no passage from the item's start has four fifths of them."""
    rng = random.Random(29)

    def prose(n):
        return ["w" + str(rng.randint(0, 30_000)) for _ in range(n)]

    item = prose(116)
    rows = [(i, " ".join(prose(120) + (item[20:] if i % 5 == 0 else []) + prose(120))) for i in range(40)]
    table = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(prose(5)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    assert got == {(i, 1) for i in range(0, 40, 5)}


def test_decontamination_beside_repeated_words(spark):
    rng = random.Random(23)

    def prose(n):
        return ["w" + str(rng.randint(0, 30_000)) for _ in range(n)]

    items = [(k, prose(40)) for k in range(6)]
    rows = []
    for i in range(60):
        words = list(items[i % 6][1])
        words[3::5] = ["other" + str(rng.randint(0, 999)) for _ in words[3::5]]  # four words in a row stay at most
        bar = ["bar" + str(i)] * 25
        rows.append((i, " ".join(prose(100) + bar + words + bar + prose(100))))
    rows += [(1000 + i, " ".join(prose(10_000))) for i in range(12)]  # so that no bar is a common word
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()}
    assert {(i, i % 6) for i in range(60)} == got


def test_decontamination_with_items_without_an_id(spark):
    rng = random.Random(29)
    items = [["w" + str(rng.randint(0, 30_000)) for _ in range(30)] for _ in range(3)]
    rows = [(1, " ".join(items[0] + ["x"] * 3 + items[1])), (2, " ".join(items[2])), (3, "nothing of them")]
    table = spark.createDataFrame([(None, " ".join(items[0])), (None, " ".join(items[1])), (7, " ".join(items[2]))], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table).collect()]
    assert sorted(got, key=str) == [(1, None), (1, None), (2, 7)]


def plain_url_scores(ruled, asked):
    """Witten-Bell models of ``ruled`` (side, text), exact counts in dictionaries."""
    counts = [{}, {}]
    for side, text in ruled:
        data = b"\2" * url_filter.ORDER + text.encode() + b"\3"
        for at in range(url_filter.ORDER, len(data)):
            for order in range(url_filter.ORDER + 1):
                after = counts[side].setdefault(data[at - order : at], {})
                after[data[at]] = after.get(data[at], 0) + 1
    for text in asked:
        data = b"\2" * url_filter.ORDER + text.encode() + b"\3"
        total = 0.0
        for at in range(url_filter.ORDER, len(data)):
            for side, sign in ((0, -1), (1, 1)):
                p = 1 / 257
                for order in range(url_filter.ORDER + 1):
                    after = counts[side].get(data[at - order : at])
                    if after:
                        p = (after.get(data[at], 0) + len(after) * p) / (sum(after.values()) + len(after))
                total += sign * math.log(p)
        yield total / (len(data) - url_filter.ORDER)


def test_url_models_keep_every_context_apart(spark):
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-é"
    urls = [f"http://{rng.choice(['a.net', 'b.example.net', 'example.com', 'c.org', 'other.xyz'])}/{rng.choice(['en', 'de', 'fr'])}/" + "".join(rng.choices(letters, k=60)) for _ in range(4000)]
    urls += [urls[0], None, "no url"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(url_filter.judge_urls(table).collect())
    rules = {h + p: int(v == "allow") for v, h, p in url_filter.RULES}
    ruled = [(rules[r.rule], r.host + r.path) for r in got if r.rule and zlib.crc32((r.host + r.path).encode()) % 4]
    want = list(plain_url_scores(ruled, [r.host + r.path for r in got]))
    assert len(got) == len(urls) and np.allclose([r.score for r in got], want, atol=1e-8)
    assert got[0].score == got[4000].score


def test_language_sample_of_a_language_of_copies(spark):
    rng = random.Random(37)
    texts = [f"{i} " + invented(rng, ["ka", "lo", "mi", "tu"], 10) for i in range(300)]
    few = [invented(rng, ["sch", "ein", "ung"], 10) for _ in range(2)]
    rows = [(t, "aa") for t in texts + texts[:1] * 20_000] + [(t, "bb") for t in few * 1500]
    seen = {}

    class Seen(language.Model):
        def __init__(self, idf, sample, *rest):
            seen.update(sample)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "Model", Seen)
        language.learn(spark.createDataFrame(rows, "text string, lang string"), 200)
    assert len(set(seen["aa"])) == len(seen["aa"]) == 200
    assert sorted(seen["bb"]) == sorted(few)


def test_counts_above_the_table_of_logarithms():
    block = np.zeros((2, language.DIMS), np.int64)
    block[0, :3], block[1, :3] = (4095, 50_000, 7), (1, 2, 3)
    idf = np.ones(language.DIMS, np.float32)
    want = np.log1p(block) / np.linalg.norm(np.log1p(block), axis=1)[:, None]
    assert np.allclose(language.scaled(block, idf), want, atol=1e-6)
