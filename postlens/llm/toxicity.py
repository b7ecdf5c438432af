"""Toxicity by a subsequence string kernel and a support vector machine.

A text is read as windows: its words, lower-cased, with runs of single letters
joined (``i d i o t``).  The kernel of two windows counts the letter fours they
share as subsequences, each weighted by ``DECAY`` to the length it is spread
over, so gaps and inserted characters cost a little instead of breaking the
match; characters that are no letters only widen gaps.  A word's start and end
count as letters.

The machine is trained on sentences of labelled documents.  A sentence stands
for its most telling window (multiple instances): first the windows that
distinct toxic sentences hold far more often than clean ones, then the windows
that the machine itself scores highest.  Landmarks span a Nyström subspace of
the kernel's; the decision is linear there, and, since the kernel is a sum over
letter fours, it folds into one weight per four for scoring.  A document's score
is a logistic regression, fitted on the training documents, on its highest
decisions and on the number and share of its windows that the machine rejects.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, let_go, id_text, judged_rows, small_batches, stored, text_slices

DECAY = 0.6
#: Longest spread of a letter four; windows this long are cut with half overlap.
SPREAD, LONGEST = 8, 40
#: Codes of letters: 0 none, 1 a word's start, 2 its end, then letters; letters
#: outside a-z share the last codes.
LETTERS = 64
#: Letter fours are numbered by a hash of this many bits.
HASH_BITS = 20
LANDMARKS = 400
#: Weight of the squared norm in the machine's loss.
RIDGE = 1e-4
#: Likelihood ratio (chi-square with one degree of freedom, p about 1e-8) that a
#: window needs to count as toxic before there is a machine to judge it.
EVIDENCE = 33.0
#: Training uses at most this many labelled documents, those of least hash.
TRAIN_DOCUMENTS = 20_000
#: Windows taken to the driver for one fit, of each kind.
FIT_WINDOWS = 3_000
ROUNDS = 3
#: Numbers that describe a document for the regression.
FEATURES = 6
KEPT = 700_000

_SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def letter_code(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 94
    return 29 + ord(c) % (LETTERS - 29) if c.isalpha() else 0


@lru_cache(maxsize=LONGEST + 4)
def _fours(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all fours of spread ``SPREAD`` or less, and their weights."""
    at = [(i, *rest) for i in range(length) for rest in combinations(range(i + 1, min(length, i + SPREAD)), 3)]
    places = np.array(at, np.int64).reshape(-1, 4)
    return places, DECAY ** (places[:, 3] - places[:, 0] + 1.0)


def four_features(windows: list[str]):
    """Per length: (window numbers, codes of letter fours, weights); weight 0
    for fours with a character that is no letter.  Equal codes of a window are
    summed in the last of them."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_length.setdefault(len(w) + 2, []).append(i)
    codes_of: dict[str, int] = {}
    for length, numbers in by_length.items():
        places, weight = _fours(length)
        if not len(places):
            continue
        step = max(1, (1 << 18) // len(places))
        for a in range(0, len(numbers), step):
            some = numbers[a:a + step]
            text = "".join(windows[i] for i in some)
            for c in set(text):
                if c not in codes_of:
                    codes_of[c] = letter_code(c)
            letters = np.empty((len(some), length), np.uint32)
            letters[:, 0], letters[:, -1] = 1, 2
            letters[:, 1:-1] = np.fromiter(map(codes_of.__getitem__, text), np.uint32, len(text)).reshape(len(some), -1)
            codes, real = np.zeros((len(some), len(places)), np.uint32), np.ones((len(some), len(places)), bool)
            for k in range(4):
                x = letters[:, places[:, k]]
                codes = codes * np.uint32(LETTERS) + x
                real &= x > 0
            # multiplicative hash; 0 is kept for fours that are none
            codes = np.where(real, np.maximum((codes * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS), 1), 0)
            order = np.argsort(codes, axis=1, kind="stable")
            codes = np.take_along_axis(codes, order, 1)
            # sums over equal codes: differences of the running sum at their ends
            running = np.cumsum(weight[order], axis=1)
            last = np.ones(codes.shape, bool)
            last[:, :-1] = codes[:, 1:] != codes[:, :-1]
            ends = np.where(last, running, 0.0)
            before = np.maximum.accumulate(np.concatenate([np.zeros((len(some), 1)), ends[:, :-1]], axis=1), axis=1)
            value = np.where(last & (codes > 0), running - before, 0.0)
            yield np.array(some), codes.astype(np.int64), value


@dataclass
class Machine:
    """Weight per letter four, bias, and the regression for documents."""

    weight: np.ndarray
    bias: float
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def decide(self, windows: list[str]) -> np.ndarray:
        out = np.full(len(windows), self.bias)
        for numbers, codes, value in four_features(windows):
            norm = np.sqrt((value * value).sum(1))
            dot = (self.weight[codes] * value).sum(1)
            out[numbers] += np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -50, 50)))


def unit_rows(windows: list[str], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length vectors over letter fours of windows over the codes ``columns``
    (sorted codes; those that occur, if not given), and these codes."""
    parts = list(four_features(windows))
    if columns is None:
        columns = np.unique(np.concatenate([c[v > 0] for _, c, v in parts] or [np.zeros(0, np.int64)]))
    place = np.full(1 << HASH_BITS, -1)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(windows), len(columns)), np.float32)
    for numbers, codes, value in parts:
        norm = np.sqrt((value * value).sum(1, keepdims=True))
        value = np.divide(value, norm, out=np.zeros_like(value), where=norm > 0)
        at = place[codes]
        r, c = np.nonzero((at >= 0) & (value > 0))
        out[numbers[r], at[r, c]] = value[r, c]  # a code has its sum in one place
    return out, columns


def fit_machine(positive: list[str], negative: list[str], weight_of: np.ndarray | None = None) -> Machine:
    """Nyström landmarks, then a linear machine with squared hinge loss."""
    landmarks: list[str] = []
    for source, share in ((positive, LANDMARKS * 3 // 4), (negative, LANDMARKS // 4)):
        pool = source[:2 * share]
        vectors, _ = unit_rows(pool)
        nearest, taken = vectors @ vectors.T, []
        del vectors
        for i in range(len(pool)):
            # a landmark close to an earlier one adds nothing to the subspace
            if len(taken) < share and nearest[i, i] > 0 and (not taken or nearest[i, taken].max() < 0.9):
                taken.append(i)
        landmarks += [pool[i] for i in taken]
    weight = np.zeros(1 << HASH_BITS)
    if not landmarks:
        return Machine(weight, -1.0)
    basis, columns = unit_rows(landmarks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    windows = positive + negative
    x = np.concatenate([unit_rows(windows[a:a + 512], columns)[0] @ basis.T
                        for a in range(0, len(windows), 512)]).astype(np.float64) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    heavy = np.ones(len(positive)) if weight_of is None else weight_of
    c = np.r_[heavy / max(1e-9, heavy.sum()), np.full(len(negative), 1 / max(1, len(negative)))]
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 0
    for _ in range(50):  # Newton steps on the squared hinge
        active = y * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge + 1e-9 * np.eye(len(w)),
                              (xa * (ca * y[active])[:, None]).sum(0))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    weight[columns] = (root @ w[:-1]) @ basis
    return Machine(weight, float(w[-1]))


def fit_curve(features: np.ndarray, label: np.ndarray, machine: Machine) -> None:
    """Logistic regression of the labels on the documents' features."""
    if not len(label) or label.min() == label.max():
        machine.curve = np.r_[np.zeros(FEATURES), 8.0 if len(label) and label.min() else -8.0]
        return
    machine.centre, machine.scale = features.mean(0), features.std(0) + 1e-6
    x = np.c_[(features - machine.centre) / machine.scale, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - label) + 1e-2 * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    machine.curve = w


def windows_of(text: str) -> list[str]:
    """The windows of a text, in order, repeats included."""
    words = text.lower().split()
    sizes = bytes(min(len(w), 255) for w in words)
    if b"\1\1\1" in sizes:
        for m in re.finditer(b"\1{3,}", sizes):
            words.append("".join(words[m.start():m.end()]))
    if sizes and max(sizes) > LONGEST or words and max(map(len, words[len(sizes):]), default=0) > LONGEST:
        words = [w[a:a + LONGEST] for w in words
                 for a in range(0, max(1, len(w) - LONGEST // 2), LONGEST // 2)]
    return words


class Scorer:
    """Features of whole texts; decisions of windows are kept."""

    def __init__(self, machine: Machine):
        self.machine, self._known = machine, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the three highest decisions among its different windows,
        how many are above 0, its length, and the share of such windows."""
        known = self._known
        if len(known) > KEPT:
            known.clear()
        split = [windows_of(t) for t in texts]
        sets = [set(windows) for windows in split]
        new = [w for w in set().union(*sets) if w not in known] if sets else []
        known.update(zip(new, self.machine.decide(new).tolist()))
        get, out = known.__getitem__, np.empty((len(texts), FEATURES))
        for i, (windows, different) in enumerate(zip(split, sets)):
            d = list(map(get, different))
            high = sorted((x for x in d if x > 0), reverse=True)
            top = (high if len(high) >= 3 else nlargest(3, d))[:3]
            top += [-2.0] * (3 - len(top))
            n = len(windows)
            out[i] = (*(min(2.0, max(-2.0, x)) for x in top), math.log1p(len(high)), math.log1p(n),
                      50 * len(high) / (n + 20))
        return out


def _score(rows: DataFrame, machine: Machine, give: str) -> DataFrame:
    """(key, features), (key, score) or (key, decision) of rows (key, text),
    the last for texts that are one window each; other columns are passed on."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)  # 2^HASH_BITS numbers, whatever the input
    more = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]

    def run(batches):
        machine = shared.value
        scorer = held(("scorer", machine.name), lambda: Scorer(machine))
        for batch in batches:
            at = 0
            for keys, texts in text_slices([batch]):
                part = batch.slice(at, len(keys))
                at += len(keys)
                if give == "decision":
                    out = pa.array(machine.decide(texts))
                elif give == "features":
                    out = pa.array(scorer.features(texts).tolist(), pa.list_(pa.float64()))
                else:
                    out = pa.array(machine.probability(scorer.features(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], out],
                                                 ["key", *part.schema.names[2:], give])

    kind = "array<double>" if give == "features" else "double"
    return rows.mapInArrow(run, ", ".join(["key long", *more, f"{give} {kind}"]))


def with_variants(told: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Windows and, of each, one with a sign between its letters, one with a
    letter put in and one with a letter doubled; the weight of each is the root
    of the number of toxic sentences that hold the window."""
    out: dict[str, float] = {}
    for n, (w, times) in enumerate(told.items()):
        k = len(w) // 2
        for x in (w, "-".join(w), w[:k] + chr(97 + n * 7 % 26) + w[k:], w[:k] + w[k - 1] + w[k:]) if len(w) >= 4 else (w,):
            out.setdefault(x, math.sqrt(times))
    # the windows themselves come first: landmarks are chosen in this order
    order = sorted(out, key=lambda x: x not in told)
    return order, np.array([out[x] for x in order])


def window_counts(labelled: DataFrame) -> DataFrame:
    """(window, n_pos, n_neg): distinct toxic and clean sentences that hold
    each window; ``labelled`` is (text, toxic).  A sentence found under both
    labels counts for the more frequent one."""
    sentences = (labelled.select(F.explode(F.split("text", _SENTENCE_END)).alias("text"), "toxic")
                 .where(F.length(F.trim("text")) > 0)
                 .groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))

    def run(batches):
        let_go()
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(windows_of(text)):
                    counts.setdefault(w, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], ["w", "p", "n"])

    return (sentences.mapInArrow(run, "w string, p long, n long")
            .groupBy("w").agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg")).withColumnRenamed("w", "window"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", limit: int = TRAIN_DOCUMENTS) -> Machine:
    """Fit on at most ``limit`` labelled documents (those whose id has the
    least hash).  Label rows with null id or label are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = (labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("toxic"))
              .where("key is not null and toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("key"), "key").limit(limit))
    # bounded: two numbers for each of at most ``limit`` documents
    rows = stored(id_text(docs, id_col, text_col).join(F.broadcast(stored(sample, "labels")), "key"), "train")
    counts = stored(window_counts(rows.select("text", "toxic")), "windows")
    total = counts.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    if total[0]:
        machine = _fit_rounds(counts, total[0], total[1] or 1)
    else:
        machine = Machine(np.zeros(1 << HASH_BITS), -1.0)
    # bounded: a few numbers for each of at most ``limit`` documents
    found = _score(rows.select("key", "text", "toxic"), machine, "features").select("features", "toxic").toPandas()
    features = np.array(found["features"].tolist(), float).reshape(-1, FEATURES)
    fit_curve(features, found["toxic"].to_numpy(float), machine)
    return machine


def _fit_rounds(counts: DataFrame, n_pos: int, n_neg: int) -> Machine:
    p, n = F.col("n_pos"), F.col("n_neg")
    share = n_pos / (n_pos + n_neg)
    odds = F.log((p + 0.5) / (n_pos + 1.0)) - F.log((n + 0.5) / (n_neg + 1.0))
    # likelihood ratio of a window's counts against the share of toxic sentences
    ratio = 2 * (p * F.log(F.greatest(p, F.lit(1)) / ((p + n) * share))
                 + n * F.log(F.greatest(n, F.lit(1)) / ((p + n) * (1 - share))))
    found = counts.where(F.length("window") >= 3).withColumn("odds", odds).withColumn("evidence", ratio)

    def take(df, *by):
        return [(r["window"], r["n_pos"]) for r in df.orderBy(*by, "window").limit(FIT_WINDOWS).collect()]

    telling = found.where("odds > 2.5")
    told = dict(take(telling.where(F.col("evidence") > EVIDENCE), F.desc("evidence"))
                or take(telling.where("n_pos >= 2"), F.desc("evidence")))
    clean = found.where("n_neg >= 1 and odds < 0.5")
    negative = [w for w, _ in dict.fromkeys(take(clean, F.desc("n_neg")) + take(clean, F.xxhash64("window")))]

    def fit():
        positive, weight = with_variants(told)
        return fit_machine(positive, negative, weight)

    machine = fit()
    keyed = found.select(F.xxhash64("window").alias("key"), F.col("window").alias("text"), "window", "n_pos", "n_neg", "odds")
    for _ in range(ROUNDS - 1):
        # clean windows that it rejects, toxic ones that it now tells
        scored = stored(_score(keyed, machine, "decision"), "scored")
        hard = take(scored.where("odds < 0.5"), F.desc("decision"))
        told |= dict(take(scored.where("n_neg = 0 and n_pos >= 2 and decision > 0.5"), F.desc("n_pos"), F.desc("decision")))
        negative = [w for w in dict.fromkeys([w for w, _ in hard] + negative) if w not in told]
        machine = fit()
    return machine


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text.

    ``score`` is between 0 and 1; null, empty and blank texts, which have no
    window, get the score of no evidence.  Repeated rows are scored each; a
    null id stays null; other columns are not read.
    """
    return (_score(id_text(docs, id_col, text_col), machine, "score").withColumnRenamed("key", id_col)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``, all columns as they
    are; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge():
        machine = shared.value
        scorer = held(("scorer", machine.name), lambda: Scorer(machine))
        return lambda texts: machine.probability(scorer.features(texts)) < limit

    return judged_rows(docs, text_col, judge)


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: no label of such a row is learnt."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0
