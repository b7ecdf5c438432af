"""Token counts at every prefix of a text, by prefix dynamic programming.

A byte-pair encoding has one useful property: the encoding of a prefix of
length ``i`` ends in exactly one token ``t`` such that the encoding of the
prefix of length ``i - len(t)`` ends in a token *compatible* with ``t`` (the
two tokens side by side encode to themselves).  So

    count[i] = count[i - len(t)] + 1

can be filled from left to right, and the finished table answers "how many
tokens has this prefix" and "how far does a budget reach" with no further
encoding.  Pieces never run from a word into the next space, so the table of a
text is the running sum of the tables of its words; these are kept per worker.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, id_text, text_slices

SPACE = "▁"
_RUN = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Tables kept per worker; beyond it the store is emptied.
KEPT = 1_000_000


class PrefixCounter:
    """Prefix tables for the words of a byte-pair model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("this model has pieces across word starts")
        # pieces that the merges can produce, as a trie over their reversed
        # characters: node = (children, number of the piece that ends here or -1)
        self.pieces = [p for p in self.score if len(self.merge(list(p))) == 1]
        self._ends: dict = {}
        for number, piece in enumerate(self.pieces):
            children, node = self._ends, None
            for c in reversed(piece):
                node = children.setdefault(c, [{}, -1])
                children = node[0]
            node[1] = number
        self._pair: dict[int, bool] = {}
        self._tables: dict[str, bytes | tuple[int, ...]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Join the best-scoring adjacent pair, leftmost first, until none is
        a piece.  Used on one or two pieces at a time."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Do these two pieces, side by side, encode to themselves?"""
        if len(self._pair) > KEPT:
            self._pair.clear()
        pair = [self.pieces[left], self.pieces[right]]
        known = self._pair[left << 20 | right] = self.merge(list(pair[0] + pair[1])) == pair
        return known

    def table(self, segment: str) -> bytes | tuple[int, ...]:
        """Token counts of all prefixes of a segment, from length 0."""
        ends, score, pairs = self._ends, self.score, self._pair
        count, last = [0], [-1]  # last: number of the last piece, -1 if none
        for i, c in enumerate(segment):
            if c not in score:  # not in the model: its bytes, and it joins nothing
                count.append(count[i] + len(c.encode()))
                last.append(-1)
                continue
            children, j = ends, i
            while True:  # pieces that end here, shortest first; just one fits
                node = children[segment[j]]
                piece = node[1]
                if piece >= 0:
                    before = last[j]
                    if before < 0:
                        break
                    fits = pairs.get(before << 20 | piece)
                    if fits or fits is None and self.compatible(before, piece):
                        break
                children = node[0]
                j -= 1
            count.append(count[j] + 1)
            last.append(piece)
        if len(self._tables) >= KEPT:
            self._tables.clear()
        known = self._tables[segment] = bytes(count) if count[-1] < 128 and max(count) < 256 else tuple(count)
        return known

    def tables(self, text: str) -> list[bytes | tuple[int, ...]]:
        """The tables of the words of a text, in order."""
        if not text:
            return []
        s = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in s:
            segments = _RUN.findall(s)
        else:
            segments = [SPACE + w for w in s.split(SPACE)[1:]]
        get, make = self._tables.get, self.table
        return [get(x) or make(x) for x in segments]

    def prefix_counts(self, text: str) -> np.ndarray:
        """count[i] for i = 0 .. len(text) characters."""
        out, base = [0], 0
        for k, t in enumerate(self.tables(text)):
            # the first segment begins with the space put before the text:
            # with no character of the text there is no token either
            out.extend(base + x for x in (t[2:] if k == 0 else t[1:]))
            base += t[-1]
        return np.asarray(out, np.int32)


def cut_point(tables: list, limit: int) -> int:
    """Characters of the longest prefix of at most ``limit`` tokens."""
    if not tables or limit <= 0:
        return 0
    starts = list(accumulate((t[-1] for t in tables), initial=0))
    if starts[-1] <= limit:
        return sum(map(len, tables)) - len(tables) - 1
    k = bisect_right(starts, limit - 1) - 1  # last word that begins within the limit
    t = tables[k]
    inside = max((i for i in range(1, len(t)) if starts[k] + t[i] <= limit), default=0)
    return max(0, sum(map(len, tables[:k])) - k + inside - 1)


def counter(model_path: str) -> PrefixCounter:
    return held(("prefixes", model_path), lambda: PrefixCounter(model_path))


def pack_counts(counts: np.ndarray) -> bytes:
    """Differences of the counts, compressed."""
    return zlib.compress(np.diff(counts, prepend=0).astype("<i4").tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<i4").cumsum()


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text", store_prefixes: bool = True) -> DataFrame:
    """Per row: key columns and ``n_bytes``, ``n_tokens``, ``cut_chars``
    (characters of the longest prefix of at most ``limit`` tokens) and, with
    ``store_prefixes``, ``prefix_counts`` (the packed count at every prefix;
    see :func:`tokens_in_prefix` and :func:`chars_for_budget`).

    Null and empty texts have 0 bytes, 0 tokens and cut 0.  Repeated rows are
    counted each; a null id stays null; other columns are not read.  No rows
    give no rows.
    """
    fields = "key long, n_bytes long, n_tokens long, cut_chars long"
    if store_prefixes:
        fields += ", prefix_counts binary"

    def run(batches):
        c = counter(model_path)
        for keys, texts in text_slices(batches):
            size, total, cut, packed = [], [], [], []
            for text in texts:
                t = c.tables(text)
                n = sum(x[-1] for x in t)
                size.append(len(text.encode()))
                total.append(n)
                cut.append(len(text) if n <= limit else cut_point(t, limit))
                if store_prefixes:
                    packed.append(pack_counts(c.prefix_counts(text)))
            columns = [pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()),
                       pa.array(cut, pa.int64())]
            names = ["key", "n_bytes", "n_tokens", "cut_chars"]
            if store_prefixes:
                columns.append(pa.array(packed, pa.binary()))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_text(docs, id_col, text_col).mapInArrow(run, fields).withColumnRenamed("key", id_col)


def tokens_in_prefix(packed: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from a stored table; null
    where the table or the number is null, the whole text beyond its end."""
    @F.pandas_udf("long")
    def look(blobs, ns):
        import pandas as pd

        out = []
        for b, n in zip(blobs, ns):
            if b is None or n is None or n != n:
                out.append(None)
                continue
            counts = unpack_counts(b)
            out.append(int(counts[min(max(int(n), 0), len(counts) - 1)]))
        return pd.Series(out, dtype="Int64")

    return look(packed, n_chars)


def chars_for_budget(packed: Column, budget: Column) -> Column:
    """Characters of the longest prefix within ``budget`` tokens, from a
    stored table; null where either is null."""
    @F.pandas_udf("long")
    def look(blobs, budgets):
        import pandas as pd

        out = []
        for b, n in zip(blobs, budgets):
            if b is None or n is None or n != n:
                out.append(None)
                continue
            fits = np.flatnonzero(unpack_counts(b) <= max(int(n), 0))
            out.append(int(fits[-1]) if len(fits) else 0)
        return pd.Series(out, dtype="Int64")

    return look(packed, budget)
