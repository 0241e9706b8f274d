"""Token ids as directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, each
further level the next chunk of the ids that have one; a bitmap a level says which
ids go on, and a rank directory (ones before every 512 bits) finds an id's place in
the next level. So token i is read with one byte and one rank a level, without
decoding a block; a run of tokens is one slice a level.

Documents are range-partitioned and sorted by id (ties by a hash of the text), so
the files in order hold all ids in ascending order. Each task writes files of a
bounded number of tokens to the shared folder and yields a row a file; a running sum
over these rows gives the global start of each file. Files of lost attempts are in
no manifest.

Strings of control tokens in a text become these tokens, as the library has it.

Null and empty texts hold the end id only. A null id sorts first. Repeated rows are
repeated. An empty table gives no file and no row.
"""

from __future__ import annotations

import gc
import json
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.common import scratch
from downfield.llm.warc import open_fs

_MAGIC, _BLOCK = b"DACIDS01", 512
_MANIFEST = "part long, seq long, file string, n_docs long, n_tokens long"
_MARKS = ".,!?;:*$%&#"
#: A space that white space or the end follows: there a text is not simply cut at spaces.
_ODD = re.compile(r" (?=\s|$)", re.DOTALL)


def byte_letters() -> list[str]:
    """The letter by which byte-level tokenizers show each byte: printable Latin-1 as it is, the others from code 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_LETTERS = byte_letters()
_SHOWN = dict(enumerate(_LETTERS))


class _Pieces(dict):
    """Ids of pieces that begin with lead; what was used in the last two spans of ``most`` new pieces is kept."""

    def __init__(self, tokenizer: object, lead: str, most: int, tail: _Pieces | None = None) -> None:
        super().__init__()
        self.tokenizer, self.ask, self.lead, self.most = tokenizer, tokenizer.model.tokenize, lead, most
        self.shown = "".join(_LETTERS[b] for b in lead.encode())
        self.tail, self.old = self if tail is None else tail, {}

    def _cut(self, piece: str) -> bytes | None:
        """Ids of a piece cut before its closing marks and around single line feeds; None if it can't be cut. What follows the last place to cut is looked up whole."""
        lines, found, of = piece.split("\n"), [], self
        last = len(lines) - 1
        for i, line in enumerate(lines):
            word = line.rstrip(_MARKS)
            if not word or not word[-1].isalpha() or (i == last and word == line) or (i < last and (not lines[i + 1] or lines[i + 1][0].isspace())):
                if not i:
                    return None
                found.append(of["\n".join(lines[i:])])
                break
            found.append(of[word])
            if word != line:
                found.append(self.tail[line[len(word) :]])
            if i < last:
                found.append(self.tail["\n"])
            of = self.tail
        return b"".join(found)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isalpha():  # one pre-token: the model is asked without the steps around it
                shown = self.shown + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN))
                ids = array("I", [t.id for t in self.ask(shown)]).tobytes()
            else:
                ids = self._cut(piece)
                if ids is None:
                    ids = array("I", self.tokenizer.encode(self.lead + piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class CachingEncoder:
    """Ids of a text by the tokenizers library, which is asked once for each distinct piece.

    A text is cut before each space that a character other than white space follows;
    the byte-level pre-tokenizer starts a token at every such place, so the pieces' ids
    are the text's. Texts that hold the string of a control token, and all texts of a
    tokenizer that is not plain byte-level BPE, are given to the library whole.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        self.by_piece = told["model"]["type"] == "BPE" and told["normalizer"] is None and not told["post_processor"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        control = [re.escape(t["content"]) for t in told["added_tokens"]]
        self.control = re.compile("|".join(control) if control else r"(?!)")
        self.plain = _Pieces(self.tokenizer, "", most // 8)
        self.spaced = _Pieces(self.tokenizer, " ", most, self.plain)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece or self.control.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if not _ODD.search(text):
            return self.plain[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))
        pieces, run = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                pieces.append(run)
                run = " " + p
            else:
                run = run + " " + p
        pieces.append(run)
        return b"".join([self.spaced[p[1:]] if p[0] == " " and not p[1:2].isspace() and len(p) > 1 else self.plain[p] for p in pieces if p])


_ENCODERS: dict[str, CachingEncoder] = {}


def encoder(path: str) -> CachingEncoder:
    """One encoder a Python worker, which serves one task after another."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachingEncoder(path)
    return _ENCODERS[path]


@contextmanager
def no_cycles() -> Iterator[None]:
    """Holds Python's search for reference cycles: it would walk the many small objects of the pieces again and again."""
    held = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if held:
            gc.enable()


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file of documents: header, ids and starts of the documents, then the levels."""
    level = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    out = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), starts.tobytes()]
    levels = 0
    while len(level) or not levels:
        more = level > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), _BLOCK)) if len(more) else np.zeros(0)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out += [struct.pack("<Q", len(level)), (level & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()]
        level, levels = level[more] >> 8, levels + 1
    return b"".join([_MAGIC, struct.pack("<QQ", len(doc_ids), levels), *out])


class TokenFile:
    """Random access to the tokens of one file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n, levels = struct.unpack_from("<QQ", data, 8)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        ids, known = take("<i8", n), take("u1", n)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            size = int(take("<u8", 1)[0])
            self.levels.append((take("u1", size), take("u1", -(-size // 8)), take("<u4", 1 - (-size // _BLOCK))))

    def _rank(self, level: int, i: int) -> int:
        """Ids before place i of the level that go on."""
        _, bits, rank = self.levels[level]
        block = i // _BLOCK
        held = np.unpackbits(bits[block * _BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * _BLOCK]
        return int(rank[block]) + int(held.sum())

    def token(self, i: int) -> int:
        """Token i, by one byte and one rank a level."""
        value = shift = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(k, i), shift + 8
        return value

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """Tokens start to stop, one slice of each level."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        if stop > start:
            more = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            if count := int(more.sum()):
                first = self._rank(level, start)
                out[more] |= self.slice(first, first + count, level + 1) << np.uint32(8)
        return out


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, file_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts, in ascending order of the key, to files in the folder; the manifest with each file's start."""
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("tie", F.xxhash64("body"))
    ordered = ordered.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "body").select("key", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seq = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        fs, path = open_fs(folder)
        fs.create_dir(posixpath.join(path, "files"), recursive=True)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        end, held = np.array([end_id], "<u4").tobytes(), 0

        def flush() -> pa.RecordBatch:
            name = f"files/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(posixpath.join(path, name), compression=None) as out:
                out.write(encode_file(keys, ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64())], names=["part", "seq", "file", "n_docs", "n_tokens"])

        with no_cycles():
            for b in batches:
                for k, t in zip(b.column("key").to_pylist(), b.column("body"), strict=True):
                    x = np.frombuffer(ids_of(t.as_py()) + end, "<u4")
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
                    if held >= file_tokens:
                        yield flush()
                        keys, ids, held, seq = [], [], 0, seq + 1
            if keys:
                yield flush()

    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, result: Callable[[TokenFile, int], tuple], schema: str, files_a_task: int = 1) -> DataFrame:
    """(doc_id, start, *result(file, i)) of each document i of each file; schema names and types result's columns."""
    rows = manifest.count()
    names = ["doc_id", "start", *(x.split()[0] for x in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("file_start").to_pylist(), strict=True):
                with fs.open_input_file(posixpath.join(path, name)) as f:
                    held = TokenFile(f.read())
                got = [result(held, i) for i in range(len(held.doc_ids))]
                cols = [pa.array(held.doc_ids, pa.int64()), pa.array(held.starts[:-1] + start, pa.int64()), *(pa.array(list(c), pa.int64()) for c in zip(*got, strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    spread = manifest.select("file", "file_start").repartition(max(1, -(-rows // files_a_task)))
    return spread.mapInArrow(run, f"doc_id long, start long, {schema}")


def digest(held: TokenFile, i: int) -> tuple[int, int]:
    """Number and crc32 (as little-endian unsigned 32-bit integers) of a document's ids."""
    ids = held.slice(int(held.starts[i]), int(held.starts[i + 1])).astype("<u4")
    return len(ids), zlib.crc32(ids.tobytes())


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, tokenizer, folder, end_id), folder, digest, "n_tokens long, ids_crc32 long")
