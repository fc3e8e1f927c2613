"""Token-id files: independent zstandard frames with a trailing seek table.

A shard is a range of doc_id in ascending order:

* data frames, each an independent zstandard frame holding the ids of some whole
  documents as little-endian unsigned 32-bit integers,
* a skippable frame with the index: an Arrow stream of (doc_id, frame, n_tokens),
* a skippable frame with the seek table of the public seekable format: for each
  data frame its compressed size, size and checksum (low half of XXH64), then the
  number of frames, a descriptor byte and the magic number; the sizes of the
  index are in front of it, so that one read of the tail finds everything.

A reader fetches the tail, the index, and only the frames of the documents it
wants; each frame is checked against its checksum. Shards are written through
the file system of the shared folder under names of their own for each attempt,
and the manifest lists those of the attempts that succeeded.
"""

from __future__ import annotations

import gc
import io
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import materialize, small_batches
from crosstide.session import shared_folder

# The public seekable format of zstandard.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX_FRAME = 0x184D2A50
FRAME = 1 << 20  # bytes of ids in a data frame; a longer document has one of its own
CACHED = 1_200_000  # words and pieces that a worker remembers
SHARD_ROWS = 20_000  # documents of a shard, on average

_encoders: dict = {}
# Latin letters, then ASCII marks: such a word is two pieces to the pre-tokenizer.
_PARTS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")


class _Spelling(dict):
    """Code points to the spelling of their UTF-8 bytes in a byte-level vocabulary.

    Bytes with a visible Latin-1 character are spelled by it, the others by the
    code points from 256 on, in order.
    """

    def __init__(self):
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, code: int) -> str:
        self[code] = spelled = "".join(self.bytes[b] for b in chr(code).encode())
        return spelled


class Encoder:
    """Encodes texts with a tokenizers file; words met before come from a cache.

    The byte-level pre-tokenizer always cuts before a single white space between
    other characters, so such a text is encoded word by word (each with the
    space or line break before it) with the same ids as the whole. Texts in
    which white space meets white space are encoded as they are. A new word of
    letters and marks after it is given to the library's model in these two
    pieces; other new words are encoded by the library in one text and taken
    apart at the ids that begin with a space or line break. A tokenizer of
    another kind fails the test at the start and encodes whole texts.
    """

    PROBE = "Öl ab cd,\nGh## it's a-b x9 ...\nÉß!? <|endoftext|> end."

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token[:1] in ("Ġ", "Ċ")  # byte-level spelling of space and line break
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.spelling = _Spelling()
        self.meeting = re.compile(r"\s\s")
        self.by_word = self.tokenizer.normalizer is None
        try:
            self.by_word = self.by_word and self.encode([self.PROBE])[0] == self.ids(self.PROBE).tobytes()
        except Exception:  # a model without byte-level spelling
            self.by_word = False

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def part(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        known = self.parts.get(piece)
        if known is None:
            ids = [t.id for t in self.model.tokenize(piece.translate(self.spelling))]
            known = self.parts[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def learn(self, new: list[str]) -> None:
        others, parts, cache, part, match = [], self.parts, self.cache, self.part, _PARTS.fullmatch
        for w in new:
            lead = w[0] if w and w[0] in "\n\t" else ""
            m = match(w, len(lead))
            if not m:
                others.append(w)
                continue
            letters, marks = m.groups()
            first = letters if lead else " " + letters
            ids = parts.get(first) or part(first)
            if marks:
                ids += parts.get(marks) or part(marks)
            cache[w] = part("\n") + ids if lead == "\n" else ids
        for w in [w for w in others if w[:1] == "\t"]:
            cache[w] = self.ids(w[1:]).tobytes()
        others = [w for w in others if w[:1] != "\t"]
        for at in range(0, len(others), 200):
            some = others[at : at + 200]
            spelled = [w if w[:1] == "\n" else " " + w for w in some]
            ids = self.ids("".join(spelled))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(some) and cuts[0] == 0:
                raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                for w, a, b in zip(some, (4 * cuts).tolist(), ends, strict=True):
                    cache[w] = raw[a:b]
            else:
                for w, s in zip(some, spelled, strict=True):
                    cache[w] = self.ids(s).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes (null: none)."""
        collecting = gc.isenabled()
        gc.disable()  # hundreds of thousands of strings, but no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) + len(self.parts) > CACHED:
            self.cache.clear()
            self.parts = {"": b""}
        words: list[str] = []
        ends = []
        for text in texts:
            if text and self.by_word and not self.meeting.search(text):
                own = text.replace("\n", " \n").split(" ")
                own[0] = "\t" + own[0]  # a first word has nothing before it
                words += own
                ends.append(len(words))
            else:
                ends.append(-1)
        found = list(map(self.cache.get, words))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        self.learn(list({words[i] for i in unknown}))
        for i in unknown:
            found[i] = self.cache[words[i]]
        out, begin = [], 0
        for text, end in zip(texts, ends, strict=True):
            if end < 0:
                out.append(self.ids(text).tobytes() if text else b"")
            else:
                out.append(b"".join(found[begin:end]))
                begin = end
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    def __init__(self, out):
        self.out, self.frames, self.pending, self.index = out, [], [], []
        self.held = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.pending and self.held + len(ids) > FRAME:
            self.flush()
        self.pending.append(ids)
        self.held += len(ids)
        self.index.append((doc_id, len(self.frames), len(ids) // 4))
        self.tokens += len(ids) // 4

    def flush(self) -> None:
        raw = b"".join(self.pending)
        frame = zstandard.ZstdCompressor(level=1).compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self.flush()
        buffer = io.BytesIO()
        columns = list(zip(*self.index, strict=True)) or [[], [], []]
        table = pa.table({"doc_id": pa.array(columns[0], pa.int64()), "frame": pa.array(columns[1], pa.int64()), "n_tokens": pa.array(columns[2], pa.int64())})
        with pa.ipc.new_stream(buffer, table.schema) as stream:
            stream.write_table(table)
        index = zstandard.ZstdCompressor(level=3).compress(buffer.getvalue())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        entries = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(index) + 8, 0, 0)])
        footer = struct.pack("<IBI", len(self.frames) + 1, 1 << 7, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class ShardReader:
    """Random access to a shard: ``index`` and the ids of wanted documents."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or descriptor != 1 << 7:
            raise ValueError("not a shard of token ids")
        source.seek(size - 9 - 12 * count)
        entries = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.frames = entries[:-1]
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        source.seek(int(self.starts[count - 1]) + 8)
        raw = zstandard.ZstdDecompressor().decompress(source.read(int(entries[-1, 0]) - 8))
        self.index = pa.ipc.open_stream(raw).read_all()

    def frame(self, i: int) -> bytes:
        self.source.seek(int(self.starts[i]))
        packed = self.source.read(int(self.frames[i, 0]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.frames[i, 1])) if self.frames[i, 1] else b""
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[i, 2]:
            raise ValueError(f"frame {i} does not match its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None):
        """(doc_id, first token in the shard, ids as bytes) in file order; only frames that hold a wanted one are read."""
        doc_ids, frames, counts = (self.index[c].to_pylist() for c in ("doc_id", "frame", "n_tokens"))
        at, held, offset, start = -1, b"", 0, 0
        for doc_id, frame, n in zip(doc_ids, frames, counts, strict=True):
            if frame != at:
                at, held, offset = frame, None, 0
            if wanted is None or doc_id in wanted:
                held = self.frame(frame) if held is None else held
                yield doc_id, start, held[offset : offset + 4 * n]
            offset += 4 * n
            start += n


def open_folder(path: str):
    """File system and path of a folder given as a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        context = TaskContext.get()
        part = context.partitionId()
        system, path = open_folder(folder)
        name = f"part-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        end, rows, coder = np.array([end_id], "<u4").tobytes(), 0, None
        out = writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}")
                coder, writer = encoder(vocabulary), ShardWriter(out)
            if batch.num_rows:
                for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                rows += batch.num_rows
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [rows], "tokens": [writer.tokens]})

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write shards in ascending doc_id order; the manifest (part, file, docs, tokens, start), one row a shard."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(8, docs.sparkSession.sparkContext.defaultParallelism, rows.select("doc_id").count() // SHARD_ROWS)
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    written = rows.mapInArrow(_write(folder, vocabulary, end_id), "part long, file string, docs long, tokens long")
    written = materialize(written, "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, each, schema: str) -> DataFrame:
    """Read every shard; ``each`` (doc_id, start, ids as bytes) gives a row of ``schema`` (long and binary columns)."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{path}/{name}") as source:
                    rows = []
                    for doc_id, first, ids in ShardReader(source).documents():
                        rows.append(each(doc_id, start + first, ids))
                        if len(rows) == 2000:
                            yield packed(rows)
                            rows = []
                    if rows:
                        yield packed(rows)

    files = manifest.select("file", "start")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _digest(doc_id, start, ids):
    return doc_id, start, len(ids) // 4, zlib.crc32(ids)


def token_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32, one row for each row of ``docs``.

    Every document ends with ``end_id``; null and empty texts have that id
    alone. Rows without an id come first, rows that repeat an id stand side by
    side. An empty table writes nothing. Other columns are not read.
    """
    folder = folder or f"{shared_folder(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, vocabulary, end_id)
    return read_token_files(manifest, folder, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
