"""Token-id files of patched frame-of-reference blocks.

A file is a row of segments; a segment holds the ids of consecutive whole
documents:

    magic "PFR1", number of ids, number of documents, number of blocks
    document keys (int64) and lengths (uint32)
    block starts: byte offsets into the packed part (uint32)
    per block: minimum (uint32), width (uint8), number of exceptions (uint16)
    packed part: per block, ids minus the block minimum in ``width`` bits each
    exceptions, block by block: places (uint16), then values (uint32)

A block has 512 ids.  Its width covers all but the share ``1 - PERCENTILE`` of
its ids; an id that needs more bits is an exception: its place and its full
difference stand in the exception list.  Segments travel as binary values of a
Parquet table with (part, seq, before, n_tokens, data), so that Spark's committer makes
retried and speculative writes safe and any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, held, id_text, text_slices

BLOCK = 512
PERCENTILE = 0.95
#: Ids in a segment, about; a document is never split.
SEGMENT = 1 << 20
#: Characters encoded together: the more, the fewer words are looked up again,
#: and the larger the arrays of their places (some 40 bytes a character).
GATHER = 4 << 20
#: Stands for a null key.
NO_KEY = -(1 << 63)
#: A worker keeps words and their ids in two halves of so many bytes; when the
#: newer one is full, the older one goes, but for the words that were used since.
#: An entry costs some bytes beside its own.
KEPT_BYTES, ENTRY_BYTES = 256 << 20, 200
#: The half of a worker that writes files: beside it an executor sorts whole
#: texts, and the words of earlier jobs are still held when the next one begins.
FILE_KEPT_BYTES = 128 << 20

FILES = "part int, seq int, before long, n_tokens long, data binary"

#: The letters that byte-level models write for bytes: printable Latin-1
#: characters stand for themselves, the others for 256 and up, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_HEAD = struct.Struct("<4sQII")


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    A byte-level model splits a text into pieces before it merges; no piece
    runs from a non-space into the next single space or line end.  So a text
    is cut there, and the ids that the library's model gives for each distinct
    word are kept per worker.  Texts with other white space or strings of added
    tokens, and models that split otherwise, are encoded whole.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = str(self.library.pre_tokenizer)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.parted = (kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind
                       and "use_regex=True" in kind and self.library.normalizer is None and len(line) == 1)
        self.line = np.array(line, "<u4").tobytes()
        self._ids: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}
        self._kept, self._most = 0, kept_bytes
        # a text is plain if no two spaces or line ends meet and none is first or last
        odd = [r"^$", r"^[ \n]", r"[ \n][ \n]", r"[ \n]$", *(re.escape(t) for t in self.added)]
        self._odd = "|".join(f"(?:{x})" for x in odd)

    def _known(self, word: str) -> bytes | None:
        ids = self._ids.get(word)
        if ids is None:
            ids = self._older.get(word)
            if ids is not None:
                self._keep(word, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> bytes:
        self._ids[word] = ids
        self._kept += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def _pieces(self, text: str) -> bytes:
        """Ids of a text without strings of added tokens: the library's
        pre-tokenizer and model, without its offsets."""
        tokens = self.library.model.tokenize
        return array("I", [t.id for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
                           for t in tokens(piece)]).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a space and letters, which are one piece: the model alone."""
        if word.isascii():
            piece = chr(BYTE_LETTERS[32]) + word
        else:
            piece = (" " + word).encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.library.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word behind a space, or behind a line end if that is its
        first character; None if it holds white space."""
        if word.isalpha():
            return self._letters(word)
        if word[-1] in ",." and word[:-1].isalpha():
            # the sign is a piece of its own
            core = self._known(word[:-1])
            if core is None:
                core = self._keep(word[:-1], self._letters(word[:-1]))
            sign = self._known("\0" + word[-1])
            if sign is None:
                sign = self._keep("\0" + word[-1], self._pieces(word[-1]))
            return core + sign
        line = word[0] == "\n"
        rest = word[1:] if line else word
        if len(rest.split()) != 1 or rest.strip() != rest:
            return None
        return self.line + self._pieces(rest) if line else self._pieces(" " + rest)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(texts), 64):
            found = self.library.encode_batch_fast(texts[a:a + 64], add_special_tokens=False)
            out += [np.array(e.ids, "<u4") for e in found]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        out: list = [None] * len(texts)
        column = pa.array(texts, pa.string())
        plain = ~np.asarray(pc.match_substring_regex(column, self._odd)) & self.parted
        at = np.flatnonzero(plain)
        if len(at):
            # a text begins as a line does; its first id, the line end, goes again
            lines = pc.binary_join_element_wise("", column.take(pa.array(at)), "\n")
            split = pc.split_pattern(pc.replace_substring(lines, "\n", " \n"), " ")
            words = split.values.dictionary_encode()
            if self._kept > self._most:
                self._older, self._ids, self._kept = self._ids, {"": b""}, 0
            different = words.dictionary.to_pylist()
            found = list(map(self._ids.get, different))
            odd = []
            for i, ids in enumerate(found):
                if ids is None:
                    ids = self._older.get(different[i])
                    if ids is None:
                        ids = self._word(different[i])
                    if ids is None:
                        odd.append(i)
                        found[i] = b""
                    else:
                        found[i] = self._keep(different[i], ids)
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(size) - size
            ids = np.frombuffer(b"".join(found), "<u4")
            index = words.indices.to_numpy()
            sizes = size[index]
            ends = np.cumsum(sizes)
            flat = ids[np.repeat(first[index] - (ends - sizes), sizes) + np.arange(ends[-1])]
            offsets = split.offsets.to_numpy()
            bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
            bad = set()
            if odd:  # words with white space of another kind: their texts are encoded whole
                hit = np.flatnonzero(np.isin(index, odd))
                bad = set((np.searchsorted(offsets - offsets[0], hit, side="right") - 1).tolist())
            for k, (i, a, b) in enumerate(zip(at.tolist(), bounds.tolist(), bounds[1:].tolist())):
                if k not in bad:
                    out[i] = flat[a + 1:b]
        left = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(left, self._whole([texts[i] for i in left])):
            out[i] = ids
        return out


def library_encoder(path: str, kept_bytes: int = KEPT_BYTES) -> LibraryEncoder:
    return held(("library", path, kept_bytes), lambda: LibraryEncoder(path, kept_bytes))


def pack_segment(keys: list[int], ids: list[np.ndarray]) -> bytes:
    """One segment from the ids of whole documents; ``ids`` has as many arrays
    for each document as there are arrays for each key."""
    each = len(ids) // max(1, len(keys))
    lengths = np.array([len(x) for x in ids], np.uint32).reshape(-1, max(1, each)).sum(1, dtype=np.uint32)
    flat = np.concatenate(ids).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    n = len(flat)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = flat
    padded[n:] = flat[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(1) if blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)  # bits that a difference needs
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    odd = bits > width[:, None]
    n_odd = odd.sum(1).astype(np.uint16)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            v = np.where(odd[at], 0, diff[at]).astype(">u4")
            cells = np.unpackbits(v.view(np.uint8).reshape(len(at), BLOCK, 4), axis=2)[:, :, 32 - w:]
            rows = np.packbits(np.ascontiguousarray(cells).reshape(len(at), -1), axis=1)
            for i, row in zip(at, rows):
                packed[i] = row.tobytes()
    starts = np.cumsum([0, *map(len, packed)])[:-1].astype(np.uint32) if blocks else np.zeros(0, np.uint32)
    where, place = np.nonzero(odd)
    return b"".join([
        _HEAD.pack(b"PFR1", n, len(keys), blocks), np.asarray(keys, "<i8").tobytes(), lengths.astype("<u4").tobytes(),
        starts.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), n_odd.astype("<u2").tobytes(),
        *packed, place.astype("<u2").tobytes(), diff[where, place].astype("<u4").tobytes()])


def unpack_segment(data: bytes, block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document keys, lengths, ids) of a segment; with ``block``, the ids of
    that block alone, found through the index of block starts."""
    magic, n, docs, blocks = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    keys, lengths, starts = take("<i8", docs), take("<u4", docs), take("<u4", blocks)
    low, width, n_odd = take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
    body = at
    at += int(sum(width.astype(np.int64)) * BLOCK // 8)
    total = int(n_odd.sum())
    place, value = take("<u2", total), take("<u4", total)
    chosen = np.arange(blocks) if block is None else np.array([block])
    grid = np.zeros((blocks, BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width[chosen]):
        rows = chosen[width[chosen] == w]
        if w:
            size = BLOCK * int(w) // 8
            bits = np.unpackbits(raw[(body + starts[rows].astype(np.int64))[:, None] + np.arange(size)], axis=1)
            cells = np.zeros((len(rows), BLOCK, 32), np.uint8)
            cells[:, :, 32 - w:] = bits.reshape(len(rows), BLOCK, w)
            grid[rows] = np.packbits(cells, axis=2).reshape(len(rows), -1).view(">u4")
    grid[np.repeat(np.arange(blocks), n_odd), place] = value
    grid += low[:, None]
    if block is not None:
        return keys, lengths, grid[block][:n - block * BLOCK]
    return keys, lengths, grid.reshape(-1)[:n]


def _segments(batches: Iterator[pa.RecordBatch], model: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part = library_encoder(model, FILE_KEPT_BYTES), TaskContext.get().partitionId()
    end = np.array([end_id], "<u4")
    keys, ids, size, seq, before = [], [], 0, 0, 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
             pa.array([size], pa.int64()), pa.array([pack_segment(keys, ids)], pa.binary())],
            ["part", "seq", "before", "n_tokens", "data"])

    for some, texts in gathered(text_slices(batches), GATHER):
        for key, found in zip(some, encoder.encode(texts)):
            keys.append(NO_KEY if key is None else key)
            ids += [found, end]
            size += len(found) + 1
            if size >= SEGMENT:
                yield flush()
                keys, ids, before, size, seq = [], [], before + size, 0, seq + 1
    if keys:
        yield flush()


def write_token_files(docs: DataFrame, model_path: str, path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 0) -> None:
    """Encode whole texts, append ``end_id`` to each, and write segments to
    ``path`` in ascending order of the id (part by part, then ``seq``).

    Null and empty texts hold the end id alone.  Null ids come first and are
    null when read.  Rows that repeat an id stand next to each other in the
    order of their text hash.  Other columns are not
    read; no rows give an empty table.
    """
    rows = id_text(docs, id_col, text_col)
    # the text hash in the range key splits an id that very many rows share
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie")
               .sortWithinPartitions("key", "tie").select("key", "text"))
    (ordered.mapInArrow(lambda it: _segments(it, model_path, end_id),
                        FILES)
     .write.option("compression", "none").parquet(path))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ``start``, ``n_tokens``, ``ids`` binary) per document; ``start`` is
    the number of ids of all documents before it."""
    return _read(spark, path, "key long, start long, n_tokens long, ids binary", lambda x: x.tobytes(), "ids",
                 pa.binary()).withColumnRenamed("key", id_col)


def read_checksums(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Like :func:`read_token_files` with ``ids_crc32`` for the ids."""
    return _read(spark, path, "key long, start long, n_tokens long, ids_crc32 long", zlib.crc32, "ids_crc32",
                 pa.int64()).withColumnRenamed("key", id_col)


def _read(spark, path, schema, digest, name, kind) -> DataFrame:
    files = spark.read.schema(FILES).parquet(path)
    # a row per writing task, of which the driver kept track anyway
    totals = files.groupBy("part").agg(F.sum("n_tokens")).collect()
    base, bases = 0, []
    for part, n in sorted(map(tuple, totals)):
        bases.append((part, base))
        base += n
    places = spark.createDataFrame(bases, "part int, base long")

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, lengths, ids = unpack_segment(data.as_buffer())
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = np.ascontiguousarray(ids, "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=keys == NO_KEY), pa.array(start + ends - lengths, pa.int64()),
                     pa.array(lengths.astype(np.int64), pa.int64()),
                     pa.array([digest(ids[a:b]) for a, b in zip(ends - lengths, ends)], kind)],
                    ["key", "start", "n_tokens", name])

    return (files.join(F.broadcast(places), "part").select((F.col("base") + F.col("before")).alias("start"), "data")
            .mapInArrow(run, schema))
