"""Fill-in-middle texts, cut at unit borders that are found eight bytes at a time.

A unit is a run of letters A-Z, a-z or any other single code point.  The UTF-8
bytes of many texts are viewed as 64-bit words; arithmetic on whole words marks
each byte that ends a unit, population counts of the marks give a running count
per word, and the byte behind a text's k-th unit is found by a search of that
count and a select inside one word.  No text is split into a list of units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_slices, id_text, utf8_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are rearranged at all, and of those so many as spm.
SPLIT_PERCENT, SPM_PERCENT = 90, 20

_ONES = np.uint64(0x0101010101010101)
_HIGH = _ONES * np.uint64(0x80)
_SEVEN, _EIGHT = np.uint64(7), np.uint64(8)


def _behind(flags: np.ndarray) -> np.ndarray:
    """For each byte, the flag of the byte behind it."""
    out = flags >> _EIGHT
    out[:-1] |= flags[1:] << np.uint64(56)
    return out


class Ends:
    """Marked bytes of a byte string: how many lie before a place, and behind
    which byte the r-th one ends."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Marked bytes among the first ``place`` bytes."""
        word = place >> 3
        low = (np.uint64(1) << ((place & 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & low)

    def select(self, r: np.ndarray) -> np.ndarray:
        """The place behind the r-th marked byte, r from 1."""
        word = np.searchsorted(self.before, r, side="left") - 1
        # byte i of ``upto``: marked bytes among the word's bytes 0..i, at most 8
        upto = (self.marks[word] >> _SEVEN) * _ONES
        asked = (r - self.before[word]).astype(np.uint64) * _ONES
        enough = ((upto | _HIGH) - asked) & _HIGH
        return word * 8 + 9 - np.bitwise_count(enough)


def unit_ends(data: np.ndarray, ends: np.ndarray) -> tuple[Ends, Ends]:
    """Ends of units and of code points in UTF-8 ``data``; no unit runs across
    the places ``ends``, where texts end."""
    words = np.zeros(len(data) // 8 + 2, "<u8")
    words.view(np.uint8)[:len(data)] = data
    inner = words & ~(words << np.uint64(1)) & _HIGH  # 10xxxxxx
    low = (words | _ONES * np.uint64(0x20)) & ~_HIGH
    letter = (low + _ONES * np.uint64(0x80 - ord("a"))) & ~(low + _ONES * np.uint64(0x7F - ord("z"))) & ~words & _HIGH
    points = _HIGH & ~_behind(inner)
    units = points & ~(letter & _behind(letter))
    last = ends[ends > 0] - 1
    np.bitwise_or.at(units, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
    return Ends(units), Ends(points)


def draws(keys: list, seed: int) -> np.ndarray:
    """Four numbers below 2^32 per key, from the SHA-256 of ``seed:key``; a
    null key is the empty string."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest() for k in keys)
    return np.frombuffer(digests, ">u4").reshape(-1, 8)[:, :4].astype(np.int64)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   split_percent: int = SPLIT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per document:
    its ``n`` units, and its text with prefix, middle and suffix set apart by
    markers: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle.

    Empty texts, texts that hold a marker and the share that is left as it is
    have the form ``plain``: the output is the text, both lengths (code points)
    are null.  A null text is empty.  The choices depend on the seed and the id
    alone, so rows of one id are cut by the same numbers; a null id counts as
    the empty string.  Whole texts of any length are cut.  Other columns are
    not read; no rows give no rows.
    """
    schema = f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string"
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for part in arrow_slices(batches, 1):
            keys, texts = part.column(0), part.column(1)
            data, at = utf8_bytes(texts)
            units, points = unit_ends(data, at[1:])
            start, end = at[:-1], at[1:]
            base = units.rank(start)
            n = units.rank(end) - base
            h = draws(keys.to_pylist(), seed)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            place = np.where(cuts > 0, units.select(np.maximum(base[:, None] + cuts, 1).ravel()).reshape(cuts.shape),
                             start[:, None])
            marked = np.zeros(len(n), bool)
            for x in (PREFIX, SUFFIX, MIDDLE):
                marked |= np.asarray(pc.match_substring(texts, x))
            plain = (n == 0) | marked | (h[:, 2] % 100 >= split_percent)
            spm = h[:, 3] % 100 < spm_percent
            chars = np.diff(points.rank(np.column_stack([start, place]).ravel()).reshape(-1, 3), axis=1)
            raw, out = data.tobytes(), []
            for a, b, c, d, whole, late in zip(*(x.tolist() for x in (start, place[:, 0], place[:, 1], end, plain, spm))):
                if whole:
                    out.append(raw[a:d])
                elif late:
                    out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                else:
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[:, 0], mask=plain),
                 pa.array(chars[:, 1], mask=plain), pa.array(out, pa.binary()).cast(pa.string())], names)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` from.  Its parts
    hold no marker, so each marker's first place is its own; null stays null."""
    def after(text: Column, skipped: int | Column) -> Column:
        return F.substring(text, F.lit(1) + skipped, F.length(text))

    def three(first: str, second: str) -> list[Column]:
        body = after(output, len(first))
        a = F.substring_index(body, second, 1)
        rest = after(body, F.length(a) + len(second))
        b = F.substring_index(rest, MIDDLE, 1)
        return [a, b, after(rest, F.length(b) + len(MIDDLE))]

    prefix, suffix, middle = three(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = three(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))
