"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt by block keys: of ``distance + 4`` blocks of bits, two
fingerprints at ``distance`` or fewer bits agree in all but ``distance`` blocks,
so one of the choices of agreeing blocks brings them together.  The free blocks
are few bits (22 of 64 at distance 2), so even a corpus of near copies puts at
most 2^22 different fingerprints under one key.

Inside a task the fingerprints of one choice are sorted by the Gray rank of
their bits, agreeing blocks first, so neighbours share most bits.  Every eight
neighbours form a node that holds the bits all of them share; bits that a
higher node holds too are factored out of the lower one.  A search goes down
the levels and adds up the differences in each node's own bits; a node whose
sum exceeds the distance goes with all below it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, let_go, stored, text_slices, with_groups
from .components import components, local_roots

SEED = 42
FANOUT = 8
#: (query, node) pairs looked at together
PAIRS = 1 << 20


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-1].tolist()]
        stops = (ends[shingle - 1:] - 1).tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], SEED) for a, b in zip(starts, stops)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""
    def run(batches):
        let_go()
        for keys, texts in text_slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps)], ["key", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "key long, fp long")


def choices(distance: int) -> list[int]:
    """Masks of the agreeing bits, one for each choice of free blocks."""
    blocks = distance + 4
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:])]
    return [sum(m for i, m in enumerate(masks) if i not in free) for free in combinations(range(blocks), distance)]


def _gather_bits(x: np.ndarray, mask: int) -> np.ndarray:
    """Bits of ``mask`` moved to the top, the others below them."""
    order = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out = np.zeros_like(x)
    for b in order:
        out = (out << np.uint64(1)) | ((x >> np.uint64(b)) & np.uint64(1))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (pattern, own bits) over sorted words, from the top down."""

    def __init__(self, words: np.ndarray):
        """``words``: distinct, in Gray order."""
        ones, zeros = words, ~words
        levels = [(words, ~np.zeros_like(words))]
        while len(ones) > FANOUT:
            cut = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            levels.append((ones, ones | zeros))
        self.levels = []
        above = None
        for pattern, shared in reversed(levels):
            own = shared if above is None else shared & ~np.repeat(above, FANOUT)[:len(shared)]
            self.levels.append((pattern, own))
            above = shared

    def search(self, words: np.ndarray, distance: int, agree: int):
        """(query, leaf) index pairs: at most ``distance`` differences, none of
        them in the bits ``agree``; in blocks of bounded size."""
        must = np.uint64(agree)
        n_top = len(self.levels[0][0])
        for a in range(0, len(words), max(1, PAIRS // FANOUT)):
            q = np.repeat(np.arange(a, min(len(words), a + PAIRS // FANOUT)), n_top)
            node = np.tile(np.arange(n_top), len(q) // n_top)
            yield from self._descend(words, distance, must, 0, q, node, np.zeros(len(q), np.uint8))

    def _descend(self, words, distance, must, level, q, node, so_far):
        pattern, own = self.levels[level]
        differ = (words[q] ^ pattern[node]) & own[node]
        so_far = so_far + np.bitwise_count(differ)
        stay = (so_far <= distance) & ((differ & must) == 0)
        q, node, so_far = q[stay], node[stay], so_far[stay]
        if level + 1 == len(self.levels):
            if len(q):
                yield q, node
            return
        below = len(self.levels[level + 1][0])
        for a in range(0, len(q), PAIRS // FANOUT):
            part = slice(a, a + PAIRS // FANOUT)
            child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = child < below
            yield from self._descend(words, distance, must, level + 1, np.repeat(q[part], FANOUT)[there],
                                     child[there], np.repeat(so_far[part], FANOUT)[there])


def linked_words(words: np.ndarray, distance: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (word, least word linked with it in here) of the words that lie
    within ``distance`` of another one and agree with it in the bits ``agree``."""
    words = np.unique(words)
    moved = _gather_bits(words, agree)
    order = np.argsort(gray_rank(moved), kind="stable")
    words, moved = words[order], moved[order]
    top = ((1 << agree.bit_count()) - 1) << (64 - agree.bit_count())
    root = np.arange(len(words))
    for q, leaf in GrayIndex(moved).search(moved, distance, top):
        more = q < leaf
        if more.any():
            a, b = root[q[more]], root[leaf[more]]
            root = local_roots(a, b, len(words))[root]
    other = np.flatnonzero(root != np.arange(len(words)))
    return words[other], words[root[other]]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that join every two fingerprints of ``fps`` (column fp)
    at ``distance`` or fewer differing bits, directly or through others."""
    masks = choices(distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = (fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed)))
                        .alias("choice", "agree"))
             .repartition("choice", "agree").select("choice", "fp"))

    def run(batches):
        got: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            choice, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            order = np.argsort(choice, kind="stable")
            kinds, at = np.unique(choice[order], return_index=True)
            for k, part in zip(kinds.tolist(), np.split(fp[order], at[1:])):
                got.setdefault(k, []).append(part)
        for k, parts in got.items():
            a, b = linked_words(np.concatenate(parts), distance, masks[k])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id), one row per
    input row.  ``component_id`` is the least id among all documents that can
    be reached over links of ``distance`` or fewer differing bits.

    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Rows with equal ids are linked too, so a component's id names one
    component and each row of an id is in it; null ids link nothing, keep
    their row but never are a component's id (a component of null ids alone
    has a null one).  Other columns are not read; no rows give no rows.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # equal fingerprints are merged before anything is dealt out
    distinct = stored(rows.groupBy("fp").agg(F.min("key").alias("first")), "distinct-fingerprints")
    # an id is one vertex whatever its rows hold: their fingerprints are linked
    ids = stored(rows.where("key is not null").groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
                 .where("b < most").select("key", "b"), "ids-of-several")
    same_id = with_groups(rows, ids, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    roots = components(links(distinct.select("fp"), distance).unionByName(same_id))
    rooted = stored(distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    names = stored(rooted.join(least, "root").select("fp", "component_id"), "component-names")
    return rows.join(names, "fp").select(F.col("key").alias(id_col),
                                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`simhash_groups`, the one of its
    least id; all columns as they are.  Of rows that share that id (they are
    linked, also where their texts differ), and of components without an id,
    the row of least text hash stays."""
    groups = stored(simhash_groups(docs, shingle, distance, id_col, text_col), "components")
    stay = groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    stay = stored(stay, "stay")
    # rows without an id: only components that have no id at all keep one
    unnamed = groups.where(F.col(id_col).isNull() & F.col("component_id").isNull()).limit(1).count()
    kept = docs.join(stay, id_col, "left_semi")
    if stay.where("_rows > 1").limit(1).count():
        clear = docs.join(stay.where("_rows = 1"), id_col, "left_semi")
        unclear = docs.join(stay.where("_rows > 1"), id_col, "left_semi")
        least = unclear.groupBy(id_col).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)),
                                                     F.xxhash64(text_col)).alias("_row"))
        kept = clear.unionByName(least.select("_row.*"))
    if unnamed:
        own = docs.where(F.col(id_col).isNull()).select(
            F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t"),
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        keyed = simhash_groups(own, shingle, distance, "k", "t")
        named = groups.where(F.col("component_id").isNotNull()).select("fingerprint").distinct()
        lone = keyed.join(named, "fingerprint", "left_anti").where("k = component_id").select("k").distinct()
        kept = kept.unionByName(own.join(lone, "k", "left_semi").dropDuplicates(["k"]).select("row.*"))
    return kept
