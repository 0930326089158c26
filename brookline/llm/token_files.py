"""Token ids in bit-plane-shuffled files: a writer, a reader and the jobs around them.

File format, little-endian throughout, one file for each range of ids (.bps):

    magic      8 bytes  b"BPSHUF01"
    chunks     each is the zstandard frames of its planes, one after another
    index      zstandard frame of a JSON object: "chunks" lists [first id, ids, offset, [bytes of each plane]],
               "docs" is the byte length of the table after it
    docs       zstandard frame: row keys as int64 deltas, then ids per row as uint32
    tail       uint64 offset of the index, uint32 bytes of index, uint64 rows, uint64 ids, b"BPSHUF01"

A chunk is a block of `block` ids (the last may be shorter). Its ids, as unsigned 32-bit integers, are
transposed into 32 bit planes (numpy.packbits of one bit of every id) or 4 byte planes. Planes above the
highest bit in use hold nothing and take 0 bytes. A reader needs the tail, the index and the chunks that it asks for.
"""

from __future__ import annotations

import io
import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookline.llm.common import give_back, kept_in_worker, lean, new_folder, written

MAGIC = b"BPSHUF01"
TAIL = struct.Struct("<QIQQ8s")
BLOCK = 1 << 16


def shuffle_block(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, lowest first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if planes == "byte":
        rows = ids.view(np.uint8).reshape(-1, 4).T
        return [row.tobytes() if row.any() else b"" for row in rows]
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little") for k in range(top)]
    return [p.tobytes() if p.any() else b"" for p in planes] + [b""] * (32 - top)


def unshuffle_block(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p:
            out[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes blocks as they fill, so memory is one block and the row table."""

    def __init__(self, out, block: int = BLOCK, planes: str = "bit", level: int = 3):
        self.out, self.block, self.planes = out, block, planes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = self.out.write(MAGIC) and len(MAGIC)
        self.chunks, self.keys, self.lengths, self.waiting, self.pending, self.ids = [], [], [], [], 0, 0

    def add(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.pending += len(ids)
        if self.pending >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(flat[k : k + self.block])
            self.waiting, self.pending = [flat[whole:]], len(flat) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.pack(p) if p else b"" for p in shuffle_block(ids, self.planes)]
        self.chunks.append([self.ids, len(ids), self.at, [len(f) for f in frames]])
        body = b"".join(frames)
        self.out.write(body)
        self.at, self.ids = self.at + len(body), self.ids + len(ids)

    def close(self) -> None:
        if self.pending:
            self._chunk(np.concatenate(self.waiting))
        keys = np.diff(np.array(self.keys, dtype="<i8"), prepend=np.int64(0))
        docs = self.pack(keys.astype("<i8").tobytes() + np.array(self.lengths, dtype="<u4").tobytes())
        index = self.pack(json.dumps({"chunks": self.chunks, "docs": len(docs)}).encode())
        self.out.write(index + docs + TAIL.pack(self.at, len(index), len(self.keys), self.ids, MAGIC))
        self.out.close()


class Reader:
    """Random access by chunk. file: a seekable file object."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - TAIL.size)
        at, n, self.rows, self.ids, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file, or cut short")
        file.seek(at)
        both = file.read(size - TAIL.size - at)
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.chunks = json.loads(self.unpack(both[:n]))["chunks"]
        table = self.unpack(both[n:])
        self.keys = np.cumsum(np.frombuffer(table, "<i8", self.rows))
        self.lengths = np.frombuffer(table, "<u4", self.rows, self.rows * 8).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        _, n, at, sizes = self.chunks[k]
        self.file.seek(at)
        body, planes, p = self.file.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unpack(body[p : p + s]) if s else b"")
            p += s
        return unshuffle_block(planes, n)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """(key, ids) in the order of the file."""
        have, parts, k = 0, [], 0
        for key, n in zip(self.keys.tolist(), self.lengths.tolist(), strict=True):
            while have < n:
                parts.append(self.chunk(k))
                have, k = have + len(parts[-1]), k + 1
            flat = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")
            yield key, flat[:n]
            parts, have = [flat[n:]], have - n


class Encoder:
    """Ids of texts by the tokenizers library. White space separates its words, so each distinct run
    between ASCII white space is encoded once and remembered. A comma or full stop after a letter is a word of its own to
    the library, and it lower-cases; runs that differ in no more than that share one encoding. Memory has two generations: when the
    newer is full (by a rough count of bytes that takes in the length of words) it becomes the older, and what is used again moves up."""

    ENTRY = 200
    #: What separates runs, and by byte of UTF-8 whether it is inside one.
    BETWEEN = b" \n\t\r"
    INSIDE = bytes(b not in b" \n\t\r" for b in range(256))

    def __init__(self, path: str, most: int = 80_000_000, most_bases: int = 100_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most, self.most_bases = Tokenizer.from_file(path), most, most_bases
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.base: dict[str, bytes] = {}
        self.older_base: dict[str, bytes] = {}
        self.size = self.base_size = 0
        # Whether an id ends a word of the library.
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True
        self.marks = {m: self._encode([m])[0] for m in ",."}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of letters alone are encoded many at a time, as one text, and cut where a word ends; if the
        cuts don't agree with the words in number, these are encoded one by one."""
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        for a in range(0, len(plain), 256):
            some = plain[a : a + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                flat = ids.tobytes()
                out.update((w, flat[4 * s : 4 * e]) for w, s, e in zip(some, [0, *cuts[:-1]], cuts, strict=True))
        rest = [w for w in words if w not in out]
        for a in range(0, len(rest), 2048):
            some = rest[a : a + 2048]
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
        return [out[w] for w in words]

    def _bytes(self, words: set[str] | list[str]) -> int:
        return 5 * sum(map(len, words)) + self.ENTRY * len(words)  # a word and its ids

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct runs that the newer generation doesn't hold."""
        self.size += self._bytes(words)
        if self.size > self.most:
            self.older, self.known, self.size = self.known, {}, self._bytes(words)
        out = list(map(self.older.get, words))
        at, bodies, marks = [k for k, found in enumerate(out) if found is None], [], []
        for w in map(words.__getitem__, at):
            mark = w[-1] if w.endswith((",", ".")) and w[-2:-1].isalpha() else ""
            body = w[:-1] if mark else w
            bodies.append(body.lower() if body.isascii() else body)
            marks.append(mark)
        ids = list(map(self.base.get, bodies))
        lacking = {b for b, found in zip(bodies, ids, strict=True) if found is None}
        self.base_size += self._bytes(lacking)
        if self.base_size > self.most_bases:
            self.older_base, self.base, self.base_size = self.base, {}, self._bytes(lacking)
        unseen = []
        for b in lacking:
            if b in self.older_base:
                self.base[b] = self.older_base[b]
            else:
                unseen.append(b)
        self.base.update(zip(unseen, self._encode(unseen), strict=True))
        for k, body, found, mark in zip(at, bodies, ids, marks, strict=True):
            found = self.base[body] if found is None else found
            out[k] = found + self.marks[mark] if mark else found
        self.known.update(zip(words, out, strict=True))
        return out

    #: Texts are taken together up to so many characters, a longer one alone: a word is looked up once for all its places in them.
    TOGETHER = 1_000_000

    def __call__(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        end = np.array([end_id], "<u4")
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > self.TOGETHER:
                yield from self._together(some, end)
                some, size = [], 0
            some.append(t)
            size += len(t) + 1
        if some:
            yield from self._together(some, end)

    def _together(self, texts: list[str], end: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text. The runs of all texts are numbered by Arrow's dictionary encoding, and the ids of a run are gathered from those of its number."""
        coded = [t.encode() for t in texts]
        raw = b" ".join([*coded, b""])
        turns = np.flatnonzero(np.diff(np.frombuffer(raw.translate(self.INSIDE), bool), prepend=False, append=False))
        starts, ends = turns[::2], turns[1::2]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, self.BETWEEN))).dictionary_encode()
        words, at = runs.dictionary.to_numpy(zero_copy_only=False).tolist(), runs.indices.to_numpy()
        found = list(map(self.known.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self.learn([words[k] for k in new]), strict=True):
            found[k] = ids
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        first, many = np.cumsum(size) - size, size[at]
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum(many, out=upto[1:])
        place = np.repeat(first[at] - upto[:-1], many)
        place += np.arange(upto[-1])
        flat = ids[place]
        cuts = upto[np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded]))].tolist()
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            yield np.concatenate((flat[a:b], end))


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, files: int | None = None, file_bytes: int = 32 << 20, block: int = BLOCK, planes: str = "bit", most: int = 80_000_000, most_bases: int = 100_000_000) -> DataFrame:
    """Write the ids of all texts to `folder` in ascending order of id; returns file, path, rows, ids, start.

    Null text is empty and gives the end id alone; null ids go first, as the least integer; repeated
    ids follow each other in the order of a text hash; an empty table gives no files. Extra columns
    are not read. Each task sorts one range of ids and writes one file under a name of its own, then
    moves it to its final name, so a task that runs twice leaves the same file. A file holds about file_bytes of text and 64 bytes a row
    (a single longer text is taken whole), so the number of files follows the input.
    `start` is a running sum over one row per file. most, most_bases: bytes of a generation of a worker's memories of words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("x", F.xxhash64("t"))
    if not files:
        size, n = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
        files = max(2 * spark.sparkContext.defaultParallelism, math.ceil((size + 64 * n) / file_bytes))
    # Equal rows may come in any order, so a number of its own lets ranges cut through very many of them.
    ranged = rows.withColumn("m", F.monotonically_increasing_id()).repartitionByRange(files, "id", "x", "m").sortWithinPartitions("id", "x", "m")
    schema = "file int, path string, rows long, ids long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer, part = kept_in_worker(f"{vocabulary} {most} {most_bases}", lambda: Encoder(vocabulary, most, most_bases)), None, TaskContext.get().partitionId()
        fs, base = _open(folder)
        name, hidden = f"{base}/part-{part:06d}.bps", f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                for key, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist(), end_id), strict=True):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        writer = Writer(fs.open_output_stream(hidden), block, planes)
                    writer.add(key, ids)
        give_back()
        if writer is not None:
            writer.close()
            fs.move(hidden, name)
            yield pa.RecordBatch.from_pylist([{"file": part, "path": f"{folder}/part-{part:06d}.bps", "rows": len(writer.keys), "ids": writer.ids}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), ("ids", pa.int64())]))

    # Batches of whole texts wait in the executor and in its Python workers, so they have few rows.
    made = written(ranged.select("id", "t").mapInArrow(write, schema), "token-files", {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"})
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every row, decoded from the files; one task reads one file."""
    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["path"])
                with fs.open_input_file(path) as f:
                    at, out = row["start"], []
                    for key, ids in Reader(f):
                        out.append((None if key == -(1 << 63) else key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] * with_ids)))
                        at += len(ids)
                        if len(out) == 1000:
                            yield _rows(out, with_ids)
                            out = []
                    if out:
                        yield _rows(out, with_ids)

    return files.select("path", "start").repartition(n).mapInArrow(lean(read), schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def tokenise(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, new_folder(docs.sparkSession, "tokens"), vocabulary, **options))


def encode_to_bytes(ids_of_rows: list[tuple[int, list[int]]], **options) -> bytes:
    """One file's bytes, for tests and small uses."""
    out = io.BytesIO()
    out.close, close = lambda: None, out.close
    w = Writer(out, **options)
    for key, ids in ids_of_rows:
        w.add(key, np.array(ids, "<u4"))
    w.close()
    return out.getvalue()
