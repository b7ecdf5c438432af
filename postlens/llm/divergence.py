"""How the sources of a language differ in their words.

Texts are read once.  Each task counts the terms of its documents per language
and source, and writes counts under fixed-width term digests beside a list of
the terms that it met; only digests are shuffled with the counts.  The least
and the greatest term of a digest tell whether two terms share it: those few
digests are counted again, term by term.  Shares, divergences and ranks work on
digests; terms are joined back for the rows that are kept.

A source's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)): its
count of the term, of all N occurrences of the V kept terms of its language.
A divergence is a sum of floor((p - q)^2 / q), in whole numbers throughout.
Terms that a source never has all get its same least share, so a pair of
sources is summed over the terms that occur, never over the whole vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_slices, small_batches, stored, utf8_bytes, with_groups
from .numbering import number_rows

#: A-Z in lower case; bytes of terms (a-z, and from 128 on those of other code
#: points) stay; all others are spaces.
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
SEED = 0
#: A task passes its counts on when it holds so many, and tells a term again
#: when it has met so many others, or terms of so many bytes.
HELD_COUNTS, KNOWN_TERMS, KNOWN_BYTES = 1_000_000, 200_000, 16 << 20
#: Kept counts handled together where sources are compared pair by pair, and
#: numbers in one array of that step.
BLOCK_COUNTS, ARRAY = 100_000, 1 << 20
#: Digests that a join may broadcast: 12 bytes each.
FEW_DIGESTS = 500_000
UNIT = 10 ** 9


def digest_of(term: bytes, bits: int) -> int:
    """The first ``bits`` bits of the term's XXH64, as a signed number."""
    d = xxhash.xxh64_intdigest(term, SEED) >> (64 - bits)
    return d - (1 << 64) if d >= 1 << 63 else d


def _terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text number, term number) of every term in order, and the terms."""
    data, at = utf8_bytes(texts)
    mapped = pa.py_buffer(_BYTES[data])
    column = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), mapped])
    split = pc.split_pattern(column, " ")
    words = split.values.dictionary_encode()
    index = words.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    terms = words.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in terms:
        there = index != terms.index(b"")
        text, index = text[there], index[there]
    return text, index, terms


def _summed(group: np.ndarray, digest: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """One row for each (group, digest), with sums of the counts."""
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    first = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(digest) != 0)]) if len(group) else np.zeros(0, np.int64)
    return [group[first], digest[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)]


class _TaskCounts:
    """Counts and terms of one task, passed on in rows of ``SCHEMA``."""

    def __init__(self, bits: int):
        self.bits = bits
        self.names: dict[tuple[str, str], int] = {}
        self.held: list[list[np.ndarray]] = []
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0

    def batch(self, group, digest, term, n, docs) -> pa.RecordBatch:
        lang, source = zip(*self.names) if self.names else ((), ())
        at = pa.array(group) if group is not None else pa.nulls(len(digest), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()).take(at), pa.array(source, pa.string()).take(at), pa.array(digest),
             pa.array(np.zeros(len(digest), np.int32)),
             pa.array(term, pa.binary()).cast(pa.string()) if term is not None else pa.nulls(len(digest), pa.string()),
             *(pa.array(c) if c is not None else pa.nulls(len(digest), pa.int64()) for c in (n, docs))],
            ["lang", "source", "digest", "split", "term", "n", "docs"])

    def add(self, part: pa.RecordBatch, with_terms: bool):
        """Count a part (text, lang, source); gives rows that can go already."""
        pairs = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
        group = np.array([self.names.setdefault(p, len(self.names)) for p in pairs], np.int64)
        text, index, terms = _terms_of(part.column(0))
        if self.known_bytes > KNOWN_BYTES or len(self.known) > KNOWN_TERMS:
            self.known.clear()
            self.known_bytes = 0
        digest = np.fromiter((self.known.get(t, -1) if t in self.known else digest_of(t, self.bits) for t in terms), np.int64,
                             len(terms))
        new = [i for i, t in enumerate(terms) if t and t not in self.known]
        self.known.update((terms[i], int(digest[i])) for i in new)
        self.known_bytes += sum(len(terms[i]) for i in new)
        size = max(1, len(terms))
        in_text, n = np.unique(text * size + index, return_counts=True)
        text, index = np.divmod(in_text, size)
        at, place = np.unique(group[text] * size + index, return_inverse=True)
        n, docs = np.bincount(place, n, len(at)).astype(np.int64), np.bincount(place, minlength=len(at))
        of, index = np.divmod(at, size)
        if with_terms:
            yield self.batch(of, digest[index], [terms[i] for i in index.tolist()], n, docs)
            return
        if new:
            yield self.batch(None, digest[new], [terms[i] for i in new], None, None)
        self.held.append([of, digest[index], n, docs.astype(np.int64)])
        if sum(len(h[0]) for h in self.held) > HELD_COUNTS:
            self.held = [_summed(*(np.concatenate(c) for c in zip(*self.held)))]
            if len(self.held[0][0]) > HELD_COUNTS // 2:
                yield from self.told()

    def told(self):
        if self.held:
            group, digest, n, docs = _summed(*(np.concatenate(c) for c in zip(*self.held)))
            self.held = []
            for a in range(0, len(group), 100_000):
                b = a + 100_000
                yield self.batch(group[a:b], digest[a:b], None, n[a:b], docs[a:b])


SCHEMA = "lang string, source string, digest long, split int, term string, n long, docs long"


def _term_counts(docs: DataFrame, bits: int, with_terms: bool) -> DataFrame:
    """Per task, rows of ``SCHEMA`` for its documents (text, lang, source), all
    of split 0.  With ``with_terms`` each row holds its term; else
    terms come by themselves, as rows whose n is null."""
    def run(batches):
        counts = _TaskCounts(bits)
        for part in arrow_slices(batches, 0):
            yield from counts.add(part, with_terms)
        yield from counts.told()

    return docs.mapInArrow(run, SCHEMA)


def counted_terms(docs: DataFrame, groups: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang_no, source_no, digest, split, n, docs): occurrences of each term in
    each source and the documents that hold it; and (digest, split, term).  A
    term is (digest, split): the split is 0 where one term has the digest, else
    its number, from 1, among the terms that share it.  ``groups`` numbers the
    sources (g, lang_no, source_no), so rows that are shuffled are all of the
    same width."""
    def numbered(rows: DataFrame) -> DataFrame:
        rows = with_groups(rows.withColumn("g", F.struct("lang", "source")), groups, "g")
        return rows.select("lang_no", "source_no", "digest", "split", "n", "docs")

    told = stored(_term_counts(docs, bits, False), "term-counts")
    counts = told.where("n is not null")  # with a split that is no constant, which Spark would take for no key
    met = told.where("n is null").select("digest", "term")
    # a task tells a term about once: nothing to sum up in front of the shuffle
    ends = stored(met.repartition("digest").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")),
                  "term-digests")
    shared = ends.where("term <> last").select("digest")
    terms = ends.where("term = last").select("digest", F.lit(0).alias("split"), "term")
    if shared.isEmpty():
        counts = numbered(counts)
    else:
        shared = stored(shared, "term-shared")
        split = stored(met.join(shared, "digest", "semi").distinct().withColumn(
            "split", F.row_number().over(Window.partitionBy("digest").orderBy("term"))).select("digest", "split", "term"),
            "term-splits")
        again = stored(_term_counts(docs, bits, True).drop("split").join(split, ["digest", "term"]), "term-counts-again")
        counts = numbered(counts.join(shared, "digest", "anti")).unionByName(numbered(again))
        terms = terms.unionByName(split)
    # a task has summed its rows already; a term has a row for each task and source at most
    sums = (counts.repartition("lang_no", "digest", "split").groupBy("lang_no", "source_no", "digest", "split")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return sums, terms


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exact also where 10^9 counts exceed a long."""
    wide = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"),
                           (total + kept).cast("decimal(20,0)"))
    short = F.call_function("div", F.lit(UNIT) * (count + 1), total + kept)
    return F.lit(1).cast("long") + F.when(count < UNIT, short).otherwise(wide)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def _floor_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def common_terms(block: pa.Table) -> pa.Table:
    """(lang_no, a, b, extra): summed over the block's terms that both sources
    have, the divergence less what it is taken for where only one of them has
    the term, with least shares for the other."""
    lang = block.column("lang_no")[0].as_py()
    digest, split, source, p, least = (block.column(c).to_numpy() for c in ("digest", "split", "source_no", "p", "least"))
    order = np.lexsort((source, split, digest))
    digest, split, source, p, least = (x[order] for x in (digest, split, source.astype(np.int64), p, least))
    first = np.flatnonzero(np.r_[True, (np.diff(digest) != 0) | (np.diff(split) != 0)])
    size = np.diff(np.r_[first, len(digest)])
    keys, sums = [], []
    for m in np.unique(size[size > 1]).tolist():
        start = first[size == m]
        step = max(1, ARRAY // (m * m))
        width = min(m, max(1, ARRAY // m))
        for a in range(0, len(start), step):
            at = start[a:a + step, None] + np.arange(m)
            for left in range(0, m, width):
                i, j = at[:, left:left + width, None], at[:, None, :]
                d = (_floor_divergence(p[i], p[j]) - _floor_divergence(p[i], least[j])
                     - _floor_divergence(least[i], p[j]) + _floor_divergence(least[i], least[j]))
                key = (source[i] << 32) + source[j]
                other = (i != j)
                found, place = np.unique(key[other], return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, place, d[other])
                keys.append(found)
                sums.append(total)
    found, place = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64),) * 2
    total = np.zeros(len(found), np.int64)
    if keys:
        np.add.at(total, place, np.concatenate(sums))
    return pa.table({"lang_no": np.full(len(found), lang, np.int64), "a": pa.array((found >> 32).astype(np.int32)),
                     "b": pa.array((found & 0xFFFFFFFF).astype(np.int32)), "extra": pa.array(total)})


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text",
                      lang_col: str = "lang", source_col: str = "source", bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of a language.

    Part ``pair``: each other source of the language with the divergence of the
    source's shares from it, summed over all kept terms.  Part ``term``: the
    terms that the source has and uses more than its language does, with their
    divergence from the language's shares; ranks to ``top``.  Ranks go by value,
    then by the item's UTF-8 bytes.

    A language keeps the terms that ``least_docs`` of its documents hold; each
    row is a document, also if it repeats another.  Null texts, languages and
    sources are empty strings; whole texts of any length are read.  Sources
    without terms have pairs, and languages without kept terms have pairs of
    value 0; a language of one source has none.  Other columns are not read; no
    rows give no rows.  ``bits``: of a digest; fewer make more terms share one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (
        (text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    sources = given.select("lang", "source").distinct()
    langs = number_rows(sources.select("lang", F.lit(0).alias("one")).distinct(), ["one"], ["lang"], "lang_no").drop("one")
    sources = stored(sources.join(langs, "lang").withColumn(
        "source_no", F.row_number().over(Window.partitionBy("lang_no").orderBy("source")))
        .withColumn("g", F.struct("lang", "source")), "term-source-numbers")
    counts, terms = counted_terms(given, sources.select("g", "lang_no", "source_no"), bits)
    of_term = Window.partitionBy("lang_no", "digest", "split")
    kept = stored(counts.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
                  .where(F.col("lang_docs") >= least_docs)
                  .select("lang_no", "source_no", "digest", "split", "n", "lang_n"), "terms-kept")

    # one row for each source of a language
    sums = kept.groupBy("lang_no", "source_no").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    # of a term's occurrences in the language, each source gives its own; a term counts once over its sources
    of_source = sums.groupBy("lang_no").agg(F.sum("total").alias("lang_total"), F.sum("has").alias("rows"))
    of_lang = kept.select("lang_no", "digest", "split").distinct().groupBy("lang_no").agg(F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("long")
    groups = sources.join(sums, ["lang_no", "source_no"], "left").join(of_source, "lang_no", "left") \
        .join(of_lang, "lang_no", "left").na.fill(0, ["total", "has", "kept", "lang_total", "rows"])
    groups = stored(groups.withColumn("least", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))))
                    .withColumn("blocks", F.ceil((F.col("rows") + 1) / F.lit(BLOCK_COUNTS)).cast("int"))
                    .withColumn("g", F.struct("lang_no", "source_no")), "term-sources")

    shares = stored(with_groups(kept.withColumn("g", F.struct("lang_no", "source_no")), groups.drop("lang_no", "source_no"), "g")
                    .select("lang_no", "source_no", "blocks", "least", "digest", "split",
                            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                            share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "term-shares")
    names = groups.select("lang_no", "source_no", "lang", "source")

    # terms: ranks by value first, ties at the end included; then with the terms themselves
    by_value = Window.partitionBy("lang_no", "source_no").orderBy(F.desc("value"))
    more = (shares.where(F.col("p") > F.col("q")).withColumn("value", divergence(F.col("p"), F.col("q")))
            .withColumn("rank", F.rank().over(by_value)).where(F.col("rank") <= top))
    more = stored(more.select("lang_no", "source_no", "digest", "split", "value"), "terms-first")
    asked = stored(more.select("digest", "split").distinct(), "terms-asked")
    few = asked.count() <= FEW_DIGESTS
    found = terms.join(F.broadcast(asked) if few else asked, ["digest", "split"])
    by_item = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = (more.join(found, ["digest", "split"]).join(names, ["lang_no", "source_no"])
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
                 .withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top))

    # pairs: least shares on both sides, then what differs by one side's terms, then by both's
    wide = "decimal(38,0)"
    other = groups.select("lang_no", F.col("source_no").alias("b"), F.col("least").alias("least_b"), F.col("has").alias("has_b"))
    neither = F.col("kept") - F.col("has") - F.col("has_b")
    both_least = groups.join(other, "lang_no").where(F.col("source_no") != F.col("b")).select(
        "lang_no", F.col("source_no").alias("a"), "b",
        F.coalesce(neither.cast(wide) * divergence(F.col("least"), F.col("least_b")), F.lit(0)).cast(wide).alias("value"))
    levels = stored(shares.groupBy("lang_no", F.col("source_no").alias("a"), "p").agg(F.count(F.lit(1)).alias("times")),
                    "term-levels")
    others = groups.groupBy("lang_no").agg(F.collect_list(F.struct("source_no", "least")).alias("others"))
    one = with_groups(levels, others, "lang_no") \
        .select("lang_no", "a", "p", "times", F.inline("others")).where(F.col("a") != F.col("source_no")) \
        .groupBy("lang_no", "a", F.col("source_no").alias("b")).agg(
            F.sum((F.col("times") * divergence(F.col("p"), F.col("least"))).cast(wide)).alias("out"),
            F.sum((F.col("times") * divergence(F.col("least"), F.col("p"))).cast(wide)).alias("back"))
    one = stored(one, "term-sides")
    block = F.pmod(F.xxhash64("digest", "split"), F.col("blocks")).cast("int")
    both = shares.select("lang_no", block.alias("block"), "digest", "split", "source_no", "p", "least") \
        .groupBy("lang_no", "block").applyInArrow(common_terms, "lang_no long, a int, b int, extra long")
    pairs = both_least.unionByName(one.select("lang_no", "a", "b", F.col("out").cast(wide).alias("value"))) \
        .unionByName(one.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").cast(wide).alias("value"))) \
        .unionByName(both.select("lang_no", "a", "b", F.col("extra").cast(wide).alias("value"))) \
        .groupBy("lang_no", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    pair_part = (pairs.join(names.withColumnRenamed("source_no", "a"), ["lang_no", "a"])
                 .join(names.select("lang_no", F.col("source_no").alias("b"), F.col("source").alias("item")), ["lang_no", "b"])
                 .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
                 .withColumn("rank", F.row_number().over(by_item)))
    return pair_part.unionByName(term_part)
