"""Removal of long repeated byte strings, exact, over the whole corpus.

Every ``length``-byte window of a text has a *key string*: among its substrings
of ``KEY`` bytes the one of least hash, leftmost if equal.  Equal windows have
equal key strings at the same place, so whatever repeats meets under one key.
Windows that lie next to each other and share a key string form a *piece*.

1.  Pieces are dealt out by the hash of their key.  Equal pieces are settled at
    once: all windows of all but the first are repeats.  A key with a single
    piece is settled too.
2.  Different pieces under one key may share windows.  The first of each goes,
    as bytes, into a Burrows-Wheeler transform, one per group of keys.  Breadth
    first, intervals of the transform are extended backward by one byte a
    level; level ``l`` marks the row boundaries whose common prefix is ``l``.
    The search stops at ``length``: rows with no boundary between them have at
    least that much in common, and the first of such rows in corpus order stays.
3.  A key under which very many different pieces meet (a common line) would put
    them all into one task and one transform.  Such pieces are split into their
    windows, which take the window itself as the key: at once for keys that are
    crowded in a sample, else after step 1.
4.  The windows found are put together per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, small_batches, stored, text_slices

LENGTH = 100
KEY = 50
#: Different pieces that a key may have in one transform.
CROWD = 1024
#: Documents of the sample that shows crowded keys, and the different pieces
#: that make a key crowded in it.
SAMPLE, SAMPLE_CROWD = 20_000, 64
#: Bytes of text whose pieces are put together before they are dealt out.
GATHER_BYTES = 16 << 20
#: Bytes of text searched for pieces at a time (some 150 bytes of memory each).
FIND_BYTES = 512 << 10
#: Text bytes behind one partition of dealt-out pieces.
PART_BYTES = 8 << 20
#: Bytes of one transform, about.
TRANSFORM_BYTES = 1 << 20
#: A byte that UTF-8 never has: it ends a piece in the transform.
END = 0xFF

_FACTOR = 0x9E3779B97F4A7C15
_LOW40 = np.uint64((1 << 40) - 1)
_OCC = np.dtype([("key", "<u8"), ("piece", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _byte_values() -> np.ndarray:
    """An odd 64-bit number for each byte, by a fixed mixing rule."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Finds the pieces of concatenated texts."""

    def __init__(self, length: int, key: int):
        self.length, self.key, self.width = length, key, length - key + 1
        self.values = _byte_values()
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(_FACTOR, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            self.up = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, _FACTOR, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, inverse, np.uint64)]))

    def find(self, buffer: np.ndarray, ends: np.ndarray):
        """(text number, start in the text, windows, key hash, piece hash)."""
        length, key, width, n = self.length, self.key, self.width, len(buffer)
        empty = np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        long = ends - starts >= length
        if not long.any():
            return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[buffer] * self.up[:n], out=sums[1:])
        grams = mix((sums[key:] - sums[:-key]) * self.down[:n - key + 1])
        # 24 bits of the hash, then the place: the least is the leftmost of the least
        order = (grams & ~_LOW40) | np.arange(len(grams), dtype=np.uint64)
        blocks = np.concatenate([order, np.full(-len(order) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        count = n - length + 1
        least = (np.minimum(behind[:count], ahead[width - 1:width - 1 + count]) & _LOW40).astype(np.int64)
        step = np.zeros(n + 2, np.int64)
        np.add.at(step, starts[long], 1)
        np.add.at(step, ends[long] - length + 1, -1)
        windows = np.flatnonzero(np.cumsum(step)[:count] > 0)
        at = least[windows]
        new = np.concatenate([[True], (np.diff(windows) > 1) | (np.diff(at) != 0)])
        first = windows[new]
        last = windows[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(windows) - 1]])]
        place = at[new]
        whole = mix((sums[last + length] - sums[first]) * self.down[first] + mix((place - first).astype(np.uint64) * np.uint64(256)
                                                                                 + (last - first).astype(np.uint64)))
        text = np.searchsorted(ends, first, side="right")
        return text, first - starts[text], last - first + 1, grams[place], whole


def _first_of_pieces(occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in the order key, piece, corpus place; mask of the first of
    each piece."""
    occ = occ[np.lexsort((occ["start"], occ["tie"], occ["doc"], occ["piece"], occ["key"]))]
    first = np.ones(len(occ), bool)
    first[1:] = (occ["key"][1:] != occ["key"][:-1]) | (occ["piece"][1:] != occ["piece"][:-1])
    return occ, first


def _ranges(kind, occ) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(occ), kind, np.int32)), pa.array(occ["key"].view(np.int64)), pa.array(occ["doc"]),
         pa.array(occ["tie"]), pa.array(occ["start"]), pa.array(occ["n"])],
        ["kind", "key", "doc", "tie", "start", "n"])


#: kinds of found ranges: windows that repeat; pieces that share a key with others; the same in a crowd
REPEAT, SHARED, CROWDED = 0, 1, 2
_FOUND = "kind int, key long, doc long, tie long, start int, n int"
_DEALT = "shard int, data binary"


def _deal(batches, make, shards: int, limit: int):
    """Occurrences of the texts in ``batches``, gathered and dealt by key; of
    equal pieces gathered together only the first goes on, the others are
    repeats (shards below 0)."""
    let_go()
    parts, size = [], 0

    def flush():
        occ, first = _first_of_pieces(np.concatenate(parts))
        shard = (occ["key"] % np.uint64(shards)).astype(np.int64)
        shard[~first] = -1 - shard[~first]
        order = np.argsort(shard, kind="stable")
        occ, shard = occ[order], shard[order]
        cut = np.flatnonzero(np.diff(shard)) + 1
        names = shard[np.concatenate([[0], cut])].astype(np.int32)
        for a in range(0, len(names), 512):
            edges = np.concatenate([[0], cut, [len(occ)]])[a:a + 513]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[a:a + 512]), pa.array([_columns(occ[i:j]) for i, j in zip(edges, edges[1:])], pa.binary())],
                ["shard", "data"])

    for batch in batches:
        for occ, n in make(batch):
            if len(occ):
                parts.append(occ)
            size += n
            if size >= limit and parts:
                yield from flush()
                parts, size = [], 0
    if parts:
        yield from flush()


def _columns(occ: np.ndarray) -> bytes:
    """Column after column: ids and places are then compressed well."""
    return b"".join(np.ascontiguousarray(occ[c]).tobytes() for c in _OCC.names)


def _rows(data: bytes) -> np.ndarray:
    n = len(data) // _OCC.itemsize
    occ, at = np.empty(n, _OCC), 0
    for c in _OCC.names:
        occ[c] = np.frombuffer(data, _OCC[c], n, at)
        at += n * _OCC[c].itemsize
    return occ


def _settle(batches):
    """Repeats, and the first occurrences of pieces that share their key."""
    parts = []
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            occ = _rows(data.as_buffer())
            if shard < 0:
                yield _ranges(REPEAT, occ)
            else:
                parts.append(occ)
    if not parts:
        return
    occ, first = _first_of_pieces(np.concatenate(parts))
    del parts
    yield _ranges(REPEAT, occ[~first])
    occ = occ[first]
    edge = np.flatnonzero(np.concatenate([[True], occ["key"][1:] != occ["key"][:-1], [True]]))
    count = np.diff(edge)
    for kind, which in ((SHARED, (count > 1) & (count <= CROWD)), (CROWDED, count > CROWD)):
        some = occ[np.repeat(which, count)]
        if len(some):
            yield _ranges(kind, some)


def _window_occurrences(single: Pieces, raw: list[bytes], docs, ties, starts) -> np.ndarray:
    """Occurrences of the single windows of pieces, each its own key."""
    ends = np.cumsum([len(b) for b in raw])
    text, start, n, key_hash, piece_hash = single.find(np.frombuffer(b"".join(raw), np.uint8), ends)
    occ = np.empty(len(text), _OCC)
    occ["key"], occ["piece"], occ["n"] = key_hash, piece_hash, n
    occ["doc"], occ["tie"], occ["start"] = docs[text], ties[text], starts[text] + start
    return occ


def _text_occurrences(length: int, key: int, crowded: np.ndarray):
    """Occurrences from batches of (doc, tie, text); pieces under the keys
    ``crowded`` (sorted hashes) are split into their windows."""
    finder: list[Pieces] = []

    def make(batch):
        if not finder:
            finder.extend([Pieces(length, key), Pieces(length, length)])
        docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = 0
        for keys, texts in text_slices([batch.select([0, 2])], FIND_BYTES):
            raw = [t.encode() for t in texts]
            ends = np.cumsum([len(b) for b in raw])
            text, start, n, key_hash, piece_hash = finder[0].find(np.frombuffer(b"".join(raw), np.uint8), ends)
            occ = np.empty(len(text), _OCC)
            occ["key"], occ["piece"], occ["start"], occ["n"] = key_hash, piece_hash, start, n
            occ["doc"], occ["tie"] = docs[at + text], ties[at + text]
            at += len(keys)
            if len(crowded) and len(occ):
                where = np.minimum(np.searchsorted(crowded, key_hash), len(crowded) - 1)
                hit = crowded[where] == key_hash
                if hit.any():
                    parts = [raw[t][s:s + m - 1 + length] for t, s, m in zip(text[hit], start[hit], n[hit])]
                    some = occ[hit]
                    occ = np.concatenate([occ[~hit], _window_occurrences(
                        finder[1], parts, some["doc"], some["tie"], some["start"])])
            yield occ, int(ends[-1]) if len(ends) else 0

    return make


def _piece_occurrences(length: int):
    """Occurrences of the single windows of pieces (key, doc, tie, start, bytes)."""
    def make(batch):
        if batch.num_rows:
            docs, ties, starts = (batch.column(i).to_numpy() for i in (1, 2, 3))
            raw = batch.column(4).to_pylist()
            yield _window_occurrences(Pieces(length, length), raw, docs, ties, starts), 40 * sum(map(len, raw))

    return make


def bounded_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the cyclic text in the order of the ``depth`` bytes or more
    that begin there: ranks over twice as many bytes, round by round."""
    wide = np.concatenate([text, text[:8]])
    rank = np.zeros(len(text), np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | wide[k:k + len(text)]
    seen, order = 8, np.argsort(rank, kind="stable")
    while seen < depth:
        ordered = rank[order]
        dense = np.empty(len(text), np.uint64)
        dense[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = (dense << np.uint64(32)) | np.roll(dense, -seen)
        order = np.argsort(rank, kind="stable")
        seen *= 2
    return order


def expand_intervals(bwt: np.ndarray, length: int) -> np.ndarray:
    """Mask over row boundaries (row i against row i - 1): common prefix below
    ``length``.  Breadth-first backward extension: the intervals of one level
    are those of patterns of equal length; an interval of the next level is
    kept if its right boundary wasn't marked yet."""
    n = len(bwt)
    inverse = np.argsort(bwt, kind="stable")  # first-column row -> transform row
    forward = np.empty(n, np.int64)
    forward[inverse] = np.arange(n)
    # neighbours with the same byte, before and after each row
    symbol = bwt[inverse]
    same = symbol[1:] == symbol[:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[inverse[:-1]] = np.where(same, inverse[1:], n)
    before[inverse[1:]] = np.where(same, inverse[:-1], -1)
    marked = np.zeros(n + 1, bool)
    marked[0] = marked[n] = True
    low, high = np.array([0]), np.array([n])
    for level in range(length):
        sizes = high - low
        shift = np.cumsum(sizes) - sizes
        rows = np.repeat(low - shift, sizes) + np.arange(sizes.sum())
        lows, highs = np.repeat(low, sizes), np.repeat(high, sizes)
        # an extended interval runs from the first to the last row of a byte
        first = np.sort(forward[rows[before[rows] < lows]])
        last = np.sort(forward[rows[after[rows] >= highs]]) + 1
        new = ~marked[last]
        if level == 0:
            new[:] = True
        marked[last] = True
        low, high = first[new], last[new]
        if not len(low):
            break
    return marked[:n]


def shared_windows(pieces: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece the numbers of its windows that occur in another piece
    of lower ``order``, or earlier in itself."""
    text = np.frombuffer(b"".join(p + bytes([END]) for p in pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    rows = bounded_order(text, length)
    below = expand_intervals(text[rows - 1], length)
    group = np.cumsum(below) - 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[rows]
    window = rows - starts[owner]
    valid = window + length <= sizes[owner]
    group, owner, window = group[valid], owner[valid], window[valid]
    place = order[owner].astype(np.int64) * (1 << 20) + window
    # rows of a group are neighbours
    size = np.bincount(group)
    size = size[size > 0]
    least = np.repeat(np.minimum.reduceat(place, np.cumsum(size) - size), size) if len(size) else place
    again = place != least
    owner, window = owner[again], window[again]
    sort = np.lexsort((window, owner))
    owner, window = owner[sort], window[sort]
    edges = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [window[a:b] for a, b in zip(edges, edges[1:])]


def _transforms(length: int):
    def run(batches):
        """Ranges of repeated windows among pieces with equal keys."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        table, key = table.take(pa.array(order)), key[order]
        sizes = np.array([len(b) for b in table.column("bytes").to_pylist()])
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        # whole keys, about TRANSFORM_BYTES together
        room = np.concatenate([[0], np.cumsum(sizes)])[edge] // TRANSFORM_BYTES
        cuts = edge[:-1][np.concatenate([[True], np.diff(room[:-1]) > 0])].tolist() + [len(key)]
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a)
            doc, tie, start = (part.column(c).to_numpy() for c in ("doc", "tie", "start"))
            place = np.empty(b - a, np.int64)
            place[np.lexsort((start, tie, doc))] = np.arange(b - a)
            found = shared_windows(part.column("bytes").to_pylist(), place, length)
            count = np.array([len(w) for w in found])
            piece = np.repeat(np.arange(b - a), count)
            window = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
            new = np.ones(len(window), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)
            runs = np.flatnonzero(new)
            occ = np.empty(len(runs), _OCC)
            occ["key"] = 0
            occ["doc"], occ["tie"] = doc[piece[runs]], tie[piece[runs]]
            occ["start"] = start[piece[runs]] + window[runs]
            occ["n"] = np.diff(np.concatenate([runs, [len(window)]]))
            yield _ranges(REPEAT, occ)

    return run


def _squeeze(batches):
    """Texts as compressed bytes, for the exchanges that carry whole texts."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress(t.encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["doc", "tie", "packed"])


def _cut_pieces(length: int):
    def run(batches):
        """Bytes of the pieces that were asked for, from (text, asked)."""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {c: [] for c in ("key", "doc", "tie", "start", "bytes", "crowded")}
            for doc, tie, packed, asked in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unpack.decompress(packed)
                for a in asked:
                    out["key"].append(a["key"])
                    out["doc"].append(doc)
                    out["tie"].append(tie)
                    out["start"].append(a["start"])
                    out["bytes"].append(raw[a["start"]:a["start"] + a["n"] - 1 + length])
                    out["crowded"].append(a["kind"] == CROWDED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["tie"], pa.int64()),
                 pa.array(out["start"], pa.int32()), pa.array(out["bytes"], pa.binary()),
                 pa.array(out["crowded"], pa.bool_())], list(out))

    return run


def remove_windows(raw: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs) for ranges (first
    window, number of windows)."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for start, n in sorted(ranges):
        stop = start + n - 1 + length
        if start > end:
            spans += 1
            kept.append(raw[at:start])
            removed += stop - start
        elif stop > end:
            removed += stop - end
        end = at = max(end, stop)
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def crowded_keys(rows: DataFrame, length: int, key: int, count: int) -> np.ndarray:
    """Key hashes under which many different pieces meet already in a sample of
    about ``SAMPLE`` documents, those of least hash: at most the sample's pieces
    divided by ``SAMPLE_CROWD``.  It only decides by which of two exact ways a
    piece goes, the same for all documents."""
    step = 1 << 20
    share = min(step, -(-SAMPLE * step // max(1, count)))
    some = rows.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(step)) < share)
    make = _text_occurrences(length, key, np.zeros(0, np.uint64))

    def run(batches):
        for batch in batches:
            for occ, _ in make(batch):
                pairs = np.unique(np.stack([occ["key"], occ["piece"]], 1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "piece"])

    met = (some.mapInArrow(run, "key long, piece long").distinct().groupBy("key").count()
           .where(F.col("count") >= SAMPLE_CROWD).select("key").toPandas())
    return np.sort(met["key"].to_numpy(np.int64).view(np.uint64))


def repeated_ranges(rows: DataFrame, length: int, key: int) -> DataFrame:
    """(doc, tie, start, n): runs of windows that also start earlier in the
    corpus, for ``rows`` (doc, tie, text)."""
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(8, (total or 0) // PART_BYTES)
    shards = 4 * parts

    def settle(dealt):
        return stored(dealt.repartition(parts, "shard").mapInArrow(_settle, _FOUND), "repeats")

    make = _text_occurrences(length, key, crowded_keys(rows, length, key, count))
    found = settle(rows.mapInArrow(lambda it: _deal(it, make, shards, GATHER_BYTES), _DEALT))
    asked = (found.where(F.col("kind") != REPEAT)
             .groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("asked")))
    packed = rows.mapInArrow(_squeeze, "doc long, tie long, packed binary")
    pieces = stored(packed.join(asked, ["doc", "tie"]).select("doc", "tie", "packed", "asked").mapInArrow(
        _cut_pieces(length), "key long, doc long, tie long, start int, bytes binary, crowded boolean"), "pieces")
    shared = pieces.where(~F.col("crowded")).select("key", "doc", "tie", "start", "bytes")
    by_transform = shared.repartition(parts, "key").mapInArrow(_transforms(length), _FOUND)
    crowd = pieces.where("crowded").select("key", "doc", "tie", "start", "bytes")
    single = settle(crowd.mapInArrow(lambda it: _deal(it, _piece_occurrences(length), shards, GATHER_BYTES), _DEALT))
    ranges = found.where(F.col("kind") == REPEAT).unionByName(by_transform).unionByName(single)
    return ranges.select("doc", "tie", "start", "n")


def cut_texts(docs: DataFrame, length: int, key: int, id_col: str, text_col: str, keep: list[str],
              as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): ``row`` holds the columns
    ``keep`` of ``docs``; ``kept`` is binary or, ``as_text``, a string without
    the bytes of characters that were cut through."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    unclear = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).count()
    # the hash is the second part of the place only where ids don't tell rows apart
    tie = F.xxhash64("text") if unclear else F.lit(0).cast("long")
    rows = rows.select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("doc"), tie.alias("tie"), "text", "row")
    long = rows.where(F.octet_length("text") >= length).select("doc", "tie", "text")
    ranges = repeated_ranges(long.dropDuplicates(["doc", "tie"]) if unclear else long, length, key)
    per_doc = ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    kind = rows.schema["row"].dataType.simpleString()

    def squeeze(batches):
        for batch in batches:
            for out in _squeeze([batch]):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3)], ["doc", "tie", "packed", "row"])

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, kept, removed, spans = [], [], [], []
            for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = unpack.decompress(packed)
                left, gone, runs = remove_windows(raw, [(r["start"], r["n"]) for r in ranges or ()], length)
                sizes.append(len(raw))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                removed.append(gone)
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept, pa.string() if as_text else pa.binary())],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    packed = rows.mapInArrow(squeeze, f"doc long, tie long, packed binary, row {kind}")
    return (packed.join(per_doc, ["doc", "tie"], "left").select("row", "packed", "ranges")
            .mapInArrow(cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, key: int = KEY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` binary): every
    byte goes that lies in a ``length``-byte string which also starts earlier
    in the corpus (at a smaller id, or earlier in the same text).

    Null and empty texts have no bytes; texts under ``length`` bytes lose none.
    Rows that repeat an id come in the order of their text hash, and rows with
    equal id and text are one document (each gets the same result).  Null ids
    count as the largest.  ``kept`` may end inside a character.  Other columns
    are not read; no rows give no rows.
    """
    return cut_texts(docs, length, key, id_col, text_col, [id_col]).select(
        F.col(f"row.`{id_col}`").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def drop_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that :func:`suffix_dedup` leaves; the bytes of a
    character that was cut through go too.  Texts that lose nothing, null ones
    included, are as they were; other columns are as they are."""
    cut = cut_texts(docs, length, key, id_col, text_col, docs.columns, as_text=True)
    return cut.select(*(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.`{c}`")).alias(c)
                        if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
