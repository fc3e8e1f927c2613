"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector over hashed character n-grams (1 to 3 bytes of the lowered
UTF-8 letters, word ends included): log of the count times the inverse document
frequency, scaled to length one. Document frequencies are counted over all
taught documents. Each language has CLUSTERS centroids, found by spherical
k-means on a sample of at most SAMPLE texts a language (chosen by a hash of the
text, the documented bound of the fit), and each centroid a radius: a text
further from its nearest centroid than nearly all taught texts of it is
rejected, that is marked as unlike every learned language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import flat, held_out, pieces, small_batches

DIMS = 1 << 12
CLUSTERS = 4
SAMPLE = 400
RADIUS_QUANTILE, RADIUS_SLACK = 0.995, 1.15
UNKNOWN = "und"

_SIMPLE = np.arange(256, dtype=np.int32)
_SIMPLE[:128] = 32  # white space, digits and marks are word ends
_SIMPLE[97:123] = np.arange(97, 123)
_SIMPLE[65:91] = np.arange(97, 123)
_LOG = np.log1p(np.arange(1 << 12)).astype(np.float32)


def grams(data: np.ndarray, offsets: np.ndarray):
    """(text, dimension) of every n-gram that has a letter."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), offsets[1:] - offsets[:-1])
    one = _SIMPLE[data]
    # capitals of the two-byte Latin letters
    one[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
    two = one[:-1] * 256 + one[1:]
    three = two[:-1] * 256 + one[2:]
    same2, same3 = (text[:-1] == text[1:]) & (two != 0x2020), (text[:-2] == text[2:]) & (three != 0x202020)

    def hashed(values, salt):
        return ((values.astype(np.uint32) + np.uint32(salt)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS.bit_length() + 1)

    owners = np.concatenate([text[one != 32], text[:-1][same2], text[:-2][same3]])
    return owners, np.concatenate([hashed(one[one != 32], 1), hashed(two[same2], 77), hashed(three[same3], 1234567)])


def counts(column: pa.Array):
    """Blocks (first text, texts x DIMS counts) of a column of texts."""
    for base, data, offsets in pieces(*flat(column), size=1 << 18):
        for begin in range(0, len(offsets) - 1, 64):
            cut = offsets[begin : begin + 65]
            owner, dimension = grams(data[cut[0] : cut[-1]], cut - cut[0])
            n = len(cut) - 1
            yield base + begin, np.bincount(owner * np.int64(DIMS) + dimension, minlength=n * DIMS).reshape(n, DIMS)


def scaled(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = _LOG[np.minimum(block, len(_LOG) - 1)]
    above = block >= len(_LOG)
    if above.any():
        out[above] = np.log1p(block[above])
    out *= idf
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-12)[:, None]
    return out


def _frequencies(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, block in counts(batch.column(0)):
            total += (block > 0).sum(0)
            n += len(block)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"dimension": np.append(used, -1), "documents": np.append(total[used], n)})


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """One row a dimension comes to the driver."""
    counted = texts.mapInArrow(_frequencies, "dimension long, documents long").groupBy("dimension").agg(F.sum("documents")).collect()
    found = dict(counted)
    n = found.pop(-1, 0)
    idf = np.full(DIMS, np.log(1.0 + n))
    for d, times in found.items():
        idf[d] = np.log((1.0 + n) / (1.0 + times))
    return (idf + 0.05).astype(np.float32)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next the vector furthest from all."""
    centres = vectors.mean(0, keepdims=True)
    while len(centres) < min(k, len(vectors)):
        centres = np.concatenate([centres, vectors[[np.argmin((vectors @ centres.T).max(1))]]])
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        centres = np.stack([vectors[nearest == i].sum(0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    """idf, centroids, their languages and radii (a distance is 1 - cosine)."""

    def __init__(self, idf: np.ndarray, sample: dict[str, list[str]], clusters: int = CLUSTERS):
        self.idf, centres, self.languages, radii = idf, [], [], []
        for language in sorted(sample):
            vectors = np.concatenate([scaled(b, idf) for _, b in counts(pa.array(sample[language]))])
            found = clustered(vectors, clusters)
            near = vectors @ found.T
            own = near.argmax(1)
            for i in range(len(found)):
                distances = 1 - near[own == i, i]
                radii.append(RADIUS_SLACK * np.quantile(distances if len(distances) else 1 - near.max(1), RADIUS_QUANTILE))
            centres.append(found)
            self.languages += [language] * len(found)
        self.centres = np.concatenate(centres).T.astype(np.float32) if centres else np.zeros((DIMS, 0), np.float32)
        self.radii = np.array(radii)

    def predict(self, column: pa.Array):
        """Index of the nearest centroid (-1 without any), its cosine and whether it is within the radius."""
        nearest, cosine = np.full(len(column), -1), np.zeros(len(column))
        if self.languages:
            for begin, block in counts(column):
                near = scaled(block, self.idf) @ self.centres
                end = begin + len(block)
                nearest[begin:end] = near.argmax(1)
                cosine[begin:end] = near.max(1)
        inside = 1 - cosine <= self.radii[nearest] if len(self.radii) else np.zeros(len(column), bool)
        return nearest, cosine, inside


def _label(model: Model):
    def run(batches):
        for batch in batches:
            nearest, cosine, inside = model.predict(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            known = letters & (nearest >= 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(3),
                    pa.array([model.languages[i] if k else UNKNOWN for i, k in zip(nearest.tolist(), known.tolist(), strict=True)]),
                    pa.array(np.where(known, np.clip(cosine, 0.0, 1.0), 0.0)),
                    pa.array(known & ~inside),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def has_letters(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def learn(taught: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (text, lang); at most ``sample`` texts of a language come to the driver."""
    idf = inverse_frequencies(taught.select("text"))
    # different texts of each language; one row a language comes to the driver, as the model does anyway
    different = taught.select("lang", F.xxhash64("text").alias("hash")).distinct()
    sizes = {language: n for language, n in different.groupBy("lang").count().collect()}
    if not sizes:
        return Model(idf, {})
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang"))
    # so many more are drawn that fewer than ``sample`` of a larger language are as good as impossible
    drawn = taught.where(draw * size < 2.0 * sample + 60).select("lang", "text", draw.alias("draw")).distinct()
    chosen: dict[str, list] = {}
    for language, text, at in drawn.toLocalIterator():
        chosen.setdefault(language, []).append((at, text))
    return Model(idf, {k: [t for _, t in sorted(v)[:sample]] for k, v in chosen.items()})


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Taught are the documents outside the held-out fold with a language and
    letters. ``lang_pred`` is the language of the nearest centroid, ``score``
    its cosine; texts that are null or have no letter, and all texts when
    nothing could be learned, are ``und`` with score 0. ``rejected`` marks texts
    beyond the radius of their centroid. Rows that repeat an id and rows without
    one are kept as they are. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    taught = rows.where(~held_out() & F.col("lang").isNotNull() & has_letters("text")).select("text", "lang")
    model = learn(taught, sample)
    asked = rows.select("doc_id", "text", has_letters("text").alias("letters"), held_out().alias("held_out"))
    return asked.mapInArrow(_label(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
