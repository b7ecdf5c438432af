"""Byte-level byte-pair encoding and decoding by DuckDB recursive queries.

Inside each Spark task an in-process DuckDB holds two tables built from a rank
file: the merges (pair of token ids -> merged id, whose rank is the id) and the
bytes of each id.  The distinct pieces of a slice of texts become token-position
rows; a recursive query joins neighbouring positions to the merges and contracts
the leftmost pair of least rank of every piece, until no pair is left.  Decoding
joins ids to their bytes and concatenates them by an ordered aggregate.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_text, text_slices

#: Pieces kept per worker with their ids; beyond it the store is emptied.
KEPT = 600_000
#: Bytes of pieces in one recursive query, and tokens in one decoding query.
QUERY_BYTES, QUERY_TOKENS = 300_000, 500_000
#: Pieces of more bytes than this are contracted by runs (see ``LONG``).
LONG_BYTES = 200
#: Rounds of one recursive query over long pieces; it keeps every round's rows,
#: so its memory is this number times the rows.
LONG_ROUNDS = 64

#: One round: every live piece contracts its leftmost pair of least rank.
#: Position ``p`` is unique over all pieces and ordered inside a piece.  With
#: one thread the rows of a round stay in that order, so the next row is taken
#: as it comes, with no sort; the query fails if a row is ever out of order.
SHORT = """
WITH RECURSIVE state(w, p, id, live) AS (
  SELECT w, p, id, true FROM tokens
  UNION ALL (
    WITH pairs AS (
      SELECT w, p, id, lead(p) OVER () AS np,
             CASE WHEN lead(w) OVER () = w THEN (id::BIGINT << 20) | lead(id) OVER () END AS pair
      FROM state WHERE live),
    ranked AS MATERIALIZED (
      SELECT pairs.w, CASE WHEN np <= p THEN error('rows out of order') ELSE p END AS p, pairs.id, pairs.np,
             merges.merged AS m FROM pairs LEFT JOIN merges USING (pair)),
    least AS (
      SELECT w, min((m::BIGINT << 32) | p) AS best, arg_min(np, (m::BIGINT << 32) | p) AS gone
      FROM ranked WHERE m IS NOT NULL GROUP BY w)
    SELECT r.w, r.p, CASE WHEN r.p = (l.best & 4294967295) THEN r.m ELSE r.id END, l.best IS NOT NULL
    FROM ranked r LEFT JOIN least l USING (w)
    WHERE l.gone IS NULL OR r.p <> l.gone))
SELECT w, p, id FROM state WHERE NOT live ORDER BY p
"""

#: For long pieces: one round contracts all pairs of the least rank, in each
#: run of overlapping ones every second from the left, which is what repeated
#: leftmost contraction comes to unless a merge of this rank can make a pair
#: of lower rank (``early``); then only the leftmost goes.
LONG = f"""
WITH RECURSIVE state(w, p, id, live, round) AS (
  SELECT w, p, id, true, 0 FROM tokens
  UNION ALL (
    WITH pairs AS (
      SELECT w, p, id, round, row_number() OVER o AS i, lead(p) OVER o AS np,
             CASE WHEN lead(w) OVER o = w THEN (id::BIGINT << 20) | lead(id) OVER o END AS pair
      FROM state WHERE live AND round < {LONG_ROUNDS} WINDOW o AS (ORDER BY p)),
    ranked AS (
      SELECT pairs.*, merges.merged AS m, merges.early FROM pairs LEFT JOIN merges USING (pair)),
    least AS (SELECT w, min((m::BIGINT << 32) | p) AS best FROM ranked WHERE m IS NOT NULL GROUP BY w),
    chosen AS (
      SELECT r.*, l.best, m IS NOT NULL AND m = l.best >> 32 AS hit FROM ranked r LEFT JOIN least l USING (w)),
    runs AS (
      SELECT *, CASE WHEN hit THEN i - row_number() OVER (PARTITION BY w, hit ORDER BY p) END AS run FROM chosen),
    picked AS (
      SELECT *, hit AND CASE WHEN early THEN p = (best & 4294967295)
                             ELSE row_number() OVER (PARTITION BY w, hit, run ORDER BY p) % 2 = 1 END AS act
      FROM runs),
    marked AS (SELECT *, lag(act, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone FROM picked)
    SELECT w, p, CASE WHEN act THEN m ELSE id END, best IS NOT NULL, round + 1 FROM marked WHERE NOT gone))
SELECT w, p, id, live FROM state WHERE NOT live OR round = {LONG_ROUNDS} ORDER BY p
"""

DECODE = """
SELECT d, unhex(string_agg(hex, '' ORDER BY p)) AS bytes, count(*) AS n FROM ids JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """An encoder and decoder over one rank file and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb

        ranks = read_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._ids: dict[str, bytes] = {}
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        # tokens that are part of a token of lower rank
        sides, of = np.array(left + right, np.int64), np.array(merged + merged, np.int64)
        early = np.zeros(max(ranks.values()) + 1, bool)
        early[sides[of < sides]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._load("merges", pair=(np.array(left, np.int64) << 20) | np.array(right, np.int64),
                   merged=np.array(merged, np.int32), early=early[np.array(merged)])
        self._load("vocabulary", id=np.array(list(ranks.values()), np.int32), hex=[t.hex() for t in ranks])

    def _load(self, name: str, **columns) -> None:
        self.db.register("source", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM source")
        self.db.unregister("source")

    def _contract(self, pieces: list[bytes], long: bool) -> list[np.ndarray]:
        sizes = np.array([len(b) for b in pieces])
        w = np.repeat(np.arange(len(pieces)), sizes)
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        p = np.arange(len(ids))
        if not long:
            self._load("tokens", w=w, p=p, id=ids)
            out = self.db.execute(SHORT).fetchnumpy()
            w, ids = out["w"], out["id"]
        else:
            done = []
            while len(w):
                self._load("tokens", w=w, p=p, id=ids)
                out = self.db.execute(LONG).fetchnumpy()
                live = np.asarray(out["live"], bool)
                done.append((out["p"][~live], out["w"][~live], out["id"][~live]))
                w, p, ids = out["w"][live], out["p"][live], out["id"][live]
            p, w, ids = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(p, kind="stable")
            w, ids = w[order], ids[order]
        ends = np.searchsorted(w, np.arange(len(pieces) + 1))
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known yet, in queries of bounded size."""
        new = [x for x in pieces if x not in self._ids]
        if len(self._ids) + len(new) > KEPT:
            self._ids.clear()
            new = list(pieces)
        raw = [x.encode() for x in new]
        size = np.array([len(b) for b in raw])
        for long in (False, True):
            chosen = np.flatnonzero((size > LONG_BYTES) == long)
            if not len(chosen):
                continue
            group = np.cumsum(size[chosen]) // QUERY_BYTES
            for part in np.split(chosen, np.flatnonzero(np.diff(group)) + 1):
                for i, ids in zip(part, self._contract([raw[i] for i in part], long)):
                    self._ids[new[i]] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self._ids.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, blobs: list[bytes]) -> list[bytes]:
        out = [b""] * len(blobs)
        sizes = np.array([len(b) // 4 for b in blobs], np.int64)
        flat = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(blobs)), sizes)
        parts: dict[int, list[bytes]] = {}
        for a in range(0, len(flat), QUERY_TOKENS):
            ids = flat[a:a + QUERY_TOKENS]
            self.db.register("ids", pa.table({"d": doc[a:a + QUERY_TOKENS], "p": np.arange(len(ids)), "id": ids}))
            found = self.db.execute(DECODE).fetchnumpy()
            self.db.unregister("ids")
            if int(found["n"].sum()) != len(ids):
                raise ValueError("ids outside the vocabulary")
            for d, b in zip(found["d"].tolist(), found["bytes"]):
                parts.setdefault(d, []).append(b)
        for d, b in parts.items():
            out[d] = b"".join(b)
        return out


def codec(ranks_path: str, pattern: str) -> Codec:
    return held(("codec", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``ids``): the ids of every whole text, as
    little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts have no ids (an empty value, never null).  Repeated
    rows are encoded each; a null id stays null; other columns are not read.
    """
    def run(batches):
        c = codec(ranks_path, pattern)
        for keys, texts in text_slices(batches):
            ids = c.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(b) // 4 for b in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    return (id_text(docs, id_col, text_col).mapInArrow(run, "key long, n_tokens long, ids binary")
            .withColumnRenamed("key", id_col))


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(id, ``n_tokens``, ``ids``, ``decoded`` binary) for the output of
    :func:`encode_texts`.  Null ids decode as none.  An id outside the
    vocabulary is an error."""
    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            keys, n, ids = batch.columns
            out = c.decode(ids.to_pylist())
            yield pa.RecordBatch.from_arrays([keys, n, ids, pa.array(out, pa.binary())],
                                             ["key", "n_tokens", "ids", "decoded"])

    return (encoded.select(F.col(id_col).cast("long").alias("key"),
                           (F.octet_length(F.coalesce(F.col(ids_col), F.lit(b""))) / 4).cast("long").alias("n_tokens"),
                           F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
            .mapInArrow(run, "key long, n_tokens long, ids binary, decoded binary")
            .withColumnRenamed("key", id_col))

