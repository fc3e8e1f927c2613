"""Benchmark decontamination by latent semantic retrieval.

1. Terms are words (marks cut off, A-Z lowered) hashed into TERMS; their weight
   is the inverse frequency over all documents. Terms that make up more than one
   word in ``COMMON`` weigh less by the ratio of the two shares, but never
   nothing: a text that is copied into many documents is made of such terms.
   A term counts once in REPEAT words of a text, so that a word repeated beside
   an item does not outweigh it.
2. Randomised SVD of the TF-IDF matrix of all passages: each passage is added
   with a random sign to one of SKETCH rows, so that every task has a random
   projection of its passages (SKETCH x TERMS, a fixed size); the projections are
   added up by block of terms. The right singular vectors of the sum are those of
   the matrix, up to the usual error of the method; RANK of them are kept, each
   over its singular value, so that no topic or language outweighs the others.
3. Items and windows of the documents are projected. A window is at least one
   and a half times as long as the items searched in it and begins at every third
   of its length, so that each place where an item can stand is inside some
   window. Windows whose cosine with an item reaches NEAR are candidates, and so
   is each place where a run of SHINGLE words of an item (all words of a shorter
   one) stands, whatever the weights are.
4. A candidate is confirmed by the longest common subsequence of words, as a
   share of the item: SAME or more is a copy; PARAPHRASE or more needs the
   answer check too, that is ANSWERS of the item's rarest words in the window.

Items are the stated query set: they come in blocks of ``ITEMS`` passages, one
pass over the documents for each block; longer items are cut into passages of
LONGEST words, any of which counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import flat, mix, pieces, small_batches, words

TERMS, SKETCH, RANK, BLOCK = 1 << 12, 144, 112, 128
COMMON = 2000
NEAR = 0.48
SHINGLE, FLAGS = 5, 22  # words; bits of a hash in the first look-up
HITS = 1 << 20  # shared runs of words looked at together
REPEAT = 16  # words of a text in which a term counts once
UNIT = 4  # words that are added up before anything else; windows begin at every so many
SAME, PARAPHRASE, ANSWERS = 0.8, 0.5, 0.8
LONGEST = 96
WINDOWS = tuple(3 * UNIT * k for k in range(1, 13))  # in words
ITEMS = 4000
PASSAGE = 48


def terms(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, their texts and their terms."""
    hashes, text, _ = words(data, offsets, between="space and marks")
    return hashes, text, (hashes >> np.uint64(20)).astype(np.int64) % TERMS


def first_of(term: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a word is the first with its term in its run of REPEAT words; ``at`` is its place in its text."""
    key = np.cumsum(at % REPEAT == 0) * TERMS + term
    first = np.ones(len(key), bool)
    for j in range(1, REPEAT):
        first[j:] &= key[j:] != key[:-j]
    return first


def _count(batches):
    total = np.zeros(TERMS, np.int64)
    for batch in batches:
        for _, data, offsets in pieces(*flat(batch.column(0))):
            total += np.bincount(terms(data, offsets)[2], minlength=TERMS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": used, "times": total[used]})


def term_weights(texts: DataFrame) -> np.ndarray:
    """Inverse frequency of each term over all documents; one row a term comes to the driver."""
    counted = texts.mapInArrow(_count, "term long, times long").groupBy("term").agg(F.sum("times").alias("times")).collect()
    times = np.zeros(TERMS)
    for term, n in counted:
        times[term] = n
    total = max(times.sum(), 1)
    share = np.maximum(times, 1) / total
    return (np.log1p(1 / share) * np.minimum(1, 1 / (COMMON * share))).astype(np.float32)


def _sketch(weights: np.ndarray):
    def run(batches):
        total = np.zeros(SKETCH * TERMS)
        for batch in batches:
            for _, data, offsets in pieces(*flat(batch.column(0))):
                hashes, text, term = terms(data, offsets)
                if not len(term):
                    continue
                first = np.searchsorted(text, np.arange(len(offsets) - 1))
                at = np.arange(len(term)) - first[text]
                passage = np.cumsum(at % PASSAGE == 0) - 1
                kept = np.where(first_of(term, at), weights[term], 0)
                squares = np.bincount(passage, kept**2)
                key = mix(np.add.reduceat(hashes, np.flatnonzero(np.diff(passage, prepend=-1))))  # alike on every run
                signs = np.where(key & np.uint64(1), 1.0, -1.0) / np.sqrt(np.maximum(squares, 1e-9))
                rows = ((key >> np.uint64(1)) % np.uint64(SKETCH)).astype(np.int64)
                total += np.bincount(rows[passage] * TERMS + term, kept * signs[passage], minlength=SKETCH * TERMS)
        blocks = total.reshape(SKETCH, TERMS).astype(np.float32)
        sums = [np.ascontiguousarray(blocks[:, i : i + BLOCK]).tobytes() for i in range(0, TERMS, BLOCK)]
        yield pa.RecordBatch.from_pydict({"block": list(range(TERMS // BLOCK)), "sums": sums})

    return run


def _add_up(batches):
    """Sums of equal blocks within a task: at most TERMS / BLOCK rows come out."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int64()), "sums": pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())})


def latent_basis(texts: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weighted basis (RANK x TERMS): a text's place is the sum of the columns of its terms."""
    schema = "block long, sums binary"
    sums = texts.mapInArrow(_sketch(weights), schema).repartition(TERMS // BLOCK, "block").mapInArrow(_add_up, schema)
    total = np.zeros((SKETCH, TERMS))
    for block, raw in sums.collect():
        total[:, block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(raw, np.float32).reshape(SKETCH, BLOCK)
    _, sizes, basis = np.linalg.svd(total, full_matrices=False)
    sizes, basis = sizes[:RANK], basis[:RANK]
    kept = sizes > 1e-3 * max(sizes[0], 1e-9)
    basis = basis * np.where(kept, sizes.max() / np.maximum(sizes, 1e-9), 0.0)[:, None]
    return (basis * weights[None, :]).astype(np.float32)


def runs_of_words(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on, as far as there are so many."""
    n = max(len(hashes) - k + 1, 0)
    rolled = hashes[:n].copy()
    for j in range(1, k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j]
    return mix(rolled)


class Runs:
    """Runs of ``k`` words of item passages: where each hash stands, as rows (window length, passage, word)."""

    def __init__(self, k: int, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.k, self.rows = k, rows[order]
        self.hashes, self.first, self.times = np.unique(hashes[order], return_index=True, return_counts=True)
        self.flags = np.zeros(1 << FLAGS, bool)
        self.flags[self.hashes >> np.uint64(64 - FLAGS)] = True

    def found(self, hashes: np.ndarray, text: np.ndarray, ends: np.ndarray):
        """Blocks (first word in the batch, row) of all runs of the texts that some passage has."""
        rolled = runs_of_words(hashes, self.k)
        at = np.flatnonzero(self.flags[rolled >> np.uint64(64 - FLAGS)])
        at = at[at + self.k <= ends[text[at]]]
        slot = np.minimum(np.searchsorted(self.hashes, rolled[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == rolled[at]
        at, slot = at[same], slot[same]
        upto = np.cumsum(self.times[slot])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, side="right")))
            n = self.times[slot[begin:end]]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(at[begin:end], n), self.rows[np.repeat(self.first[slot[begin:end]], n) + rank]
            begin = end


class Items:
    """A block of item passages, ready for search: by window length their places, masks and answers; runs of their words."""

    def __init__(self, rows: list[tuple[int, str | None]], basis: np.ndarray, weights: np.ndarray):
        self.by_window: dict[int, list] = {}
        runs: dict[int, list] = {}
        for number, (item_id, text) in enumerate(rows):
            data, offsets = flat(pa.array([text], pa.string()))
            hashes, _, term = terms(data, offsets)
            last = max(len(hashes) - LONGEST, 0)  # the last passage of a long item overlaps the one before
            for at in (min(start, last) for start in range(0, len(hashes), LONGEST)):
                own, seen = hashes[at : at + LONGEST].tolist(), term[at : at + LONGEST]
                places = basis[:, seen[first_of(seen, np.arange(len(seen)))]].sum(1)
                masks: dict[int, int] = {}
                for i, w in enumerate(own):
                    masks[w] = masks.get(w, 0) | 1 << i
                rare = weights[seen]
                answers = {own[i] for i in np.argsort(-rare, kind="stable")[: max(2, len(own) // 5)]}
                # a copy has all but a fifth of the item's words, so at least so many different ones
                least = len(masks) - (1 - SAME) * len(own)
                window = next(w for w in WINDOWS if 2 * w >= 3 * len(own))
                known = self.by_window.setdefault(window, [])
                k = min(SHINGLE, len(own))
                rolled = runs_of_words(hashes[at : at + LONGEST], k)
                runs.setdefault(k, []).append((rolled, np.stack([np.full(len(rolled), window), np.full(len(rolled), len(known)), np.arange(len(rolled))], 1)))
                known.append(((item_id, number if item_id is None else None), len(own), places / max(np.linalg.norm(places), 1e-9), masks, answers, set(own), least))
        self.runs = [Runs(k, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) for k, found in runs.items()]
        self.places = {w: np.stack([x[2] for x in found]).astype(np.float32) for w, found in self.by_window.items()}


def common_subsequence(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    full = state = (1 << n) - 1
    for w in other:
        m = masks.get(w)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


def windows_of(first: np.ndarray, last: np.ndarray, length: int):
    """(text, begin, end) of windows of ``length`` units from each third of it on; the last reaches the end."""
    step = length // 3
    counts = np.where(last > first, np.maximum(1, -(-(last - first) // step) - 2), 0)
    text = np.repeat(np.arange(len(first)), counts)
    begin = first[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    return text, begin, np.minimum(begin + length, last[text])


def unit_sums(text: np.ndarray, term: np.ndarray, firsts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
    """Running sums of the rows of the terms, unit by unit, and where the units of each text begin."""
    units = -(-(ends - firsts) // UNIT)
    begins = np.concatenate([[0], np.cumsum(units)])
    padded = np.full(begins[-1] * UNIT, TERMS)  # the row of TERMS is zero
    at = np.arange(len(term)) - firsts[text]
    padded[begins[text] * UNIT + at] = np.where(first_of(term, at), term, TERMS)
    sums = np.zeros((rows.shape[1], begins[-1] + 1), np.float32)
    blocks = np.take(rows, padded, axis=0).reshape(-1, UNIT, rows.shape[1]).sum(1)
    np.cumsum(np.ascontiguousarray(blocks.T), axis=1, out=sums[:, 1:])
    return sums, begins


def _search(items: Items, basis: np.ndarray):
    def run(batches):
        rows = np.concatenate([basis.T, np.zeros((1, len(basis)), np.float32)])
        for batch in batches:
            ids = batch.column(0)
            found = []
            for base, data, offsets in pieces(*flat(batch.column(1))):
                hashes, text, term = terms(data, offsets)
                if not len(term):
                    continue
                ends = np.cumsum(np.bincount(text, minlength=len(offsets) - 1))
                firsts = np.concatenate([[0], ends[:-1]])
                sums, begins = unit_sums(text, term, firsts, ends, rows)
                best: dict[tuple[int, tuple], tuple] = {}

                def confirm(length, item, doc, b, e, cosine):
                    at = firsts[doc] + UNIT * (b - begins[doc])
                    till = firsts[doc] + UNIT * (e - begins[doc])
                    for j, d, a, z, c in zip(item.tolist(), doc.tolist(), at.tolist(), till.tolist(), cosine.tolist(), strict=True):
                        item_id, n, _, masks, answers, own, least = items.by_window[length][j]
                        span = hashes[max(firsts[d], a - n // 2) : min(ends[d], z + n // 2)].tolist()
                        answered = len(answers.intersection(span)) / len(answers)
                        if answered < ANSWERS and len(own.intersection(span)) < least:
                            continue
                        share = common_subsequence(masks, n, span) / n
                        if share < PARAPHRASE:
                            continue
                        if share >= SAME or answered >= ANSWERS:
                            row = share, answered, c, a - int(firsts[d])
                            best[d, item_id] = max(best.get((d, item_id), row), row)

                for length, known in items.by_window.items():
                    owner, begin, end = windows_of(begins[:-1], begins[1:], length // UNIT)
                    for cut in range(0, len(owner), 20000):
                        doc, b, e = owner[cut : cut + 20000], begin[cut : cut + 20000], end[cut : cut + 20000]
                        place = np.take(sums, e, axis=1) - np.take(sums, b, axis=1)
                        size = np.sqrt(np.einsum("ij,ij->j", place, place))
                        near = items.places[length] @ place
                        item, window = np.nonzero(near >= NEAR * np.maximum(size, 1e-6))
                        confirm(length, item, doc[window], b[window], e[window], near[item, window] / size[window])
                for runs in items.runs:
                    for at, rows_found in runs.found(hashes, text, ends):
                        doc = text[at]
                        b = begins[doc] + np.maximum(at - firsts[doc] - rows_found[:, 2], 0) // UNIT
                        # all runs of one copy point to the same window
                        length, item, doc, b = np.unique(np.stack([rows_found[:, 0], rows_found[:, 1], doc, b]), axis=1)
                        e = np.minimum(b + length // UNIT, begins[doc + 1])
                        for one in np.unique(length).tolist():
                            of = np.flatnonzero(length == one)
                            for cut in range(0, len(of), 20000):
                                some = of[cut : cut + 20000]
                                place = np.take(sums, e[some], axis=1) - np.take(sums, b[some], axis=1)
                                size = np.sqrt(np.einsum("ij,ij->j", place, place))
                                cosine = np.einsum("ji,ij->j", items.places[one][item[some]], place) / np.maximum(size, 1e-6)
                                confirm(one, item[some], doc[some], b[some], e[some], cosine)
                found += [(ids[base + doc].as_py(), item_id, *row) for (doc, (item_id, _)), row in best.items()]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            names = ["doc_id", "item_id", "subsequence", "answers", "cosine", "at_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


SCHEMA = "doc_id long, item_id long, subsequence double, answers double, cosine double, at_word long"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it.

    doc_id, item_id, subsequence (share of the item's words in order), answers
    (share of its rarest words), cosine, at_word (where the best window begins).
    Null and empty texts and items hold nothing and are found nowhere. Rows that
    repeat an id each give their rows; ids may be null. Items without an id are
    searched as items of their own and give rows with a null item_id. Other
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = term_weights(texts.select("text"))
    basis = latent_basis(texts.select("text"), weights)
    results, block = [], []
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        block.append(tuple(row))
        if len(block) == ITEMS:
            results.append(texts.mapInArrow(_search(Items(block, basis, weights), basis), SCHEMA))
            block = []
    results.append(texts.mapInArrow(_search(Items(block, basis, weights), basis), SCHEMA))
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    return found

