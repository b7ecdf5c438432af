"""Token counts, byte-level BPE, token files: against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlens.llm import byte_bpe, token_counts, token_files
from postlens.llm.common import scratch

from .conftest import EDGE, documents

PIECES = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
SHORT = [t or "" for t in EDGE if t is None or len(t) < 600]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, letters, longest, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(1, longest))) for _ in range(n)]


def test_every_prefix(pieces):
    c = token_counts.counter(PIECES)
    for t in SHORT[:4] + random_texts(60, "ab cdeé 日🤗.\n▁thing  ", 40):
        want = [len(pieces.encode(t[:i])) for i in range(len(t) + 1)]
        assert c.prefix_counts(t).tolist() == want
        for limit in (0, 1, 5):
            assert token_counts.cut_point(c.tables(t), limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_counts_and_stored_prefixes(spark, pieces):
    docs = documents(spark, EDGE)
    got = token_counts.token_counts(docs, PIECES, limit=4096)
    got = got.withColumn("at9", token_counts.tokens_in_prefix(F.col("prefix_counts"), F.lit(9))).withColumn(
        "fits", token_counts.chars_for_budget(F.col("prefix_counts"), F.lit(3)))
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(t or "" for t in EDGE):
        n = len(pieces.encode(t))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"]) == (len(t.encode()), n)
        assert rows[i]["at9"] == len(pieces.encode(t[:9]))
        assert len(pieces.encode(t[:rows[i]["fits"]])) <= 3
        assert rows[i]["cut_chars"] == len(t) if n <= 4096 else len(pieces.encode(t[:rows[i]["cut_chars"]])) <= 4096
    assert token_counts.token_counts(docs.where("false"), PIECES, 10).count() == 0


def test_encode_decode(spark, tik):
    texts = EDGE + ["x" * 999, "ab" * 700 + "=" * 1001] + random_texts(20, "theing lyr=-", 400)
    enc = byte_bpe.encode_texts(documents(spark, texts), RANKS, P.PATTERN)
    rows = {r["doc_id"]: r for r in byte_bpe.decode_ids(enc, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(t or "" for t in texts):
        ids = tik.encode_ordinary(t)
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids
        assert rows[i]["n_tokens"] == len(ids)
        assert bytes(rows[i]["decoded"]) == t.encode()


def test_wrong_id_is_an_error(spark):
    bad = spark.createDataFrame([(0, np.array([5], "<u4").tobytes()), (1, np.array([7, 99_999_999], "<u4").tobytes())],
                                "doc_id long, ids binary")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode_ids(bad, RANKS, P.PATTERN).collect()


def test_library_encoder():
    lib, own = Tokenizer.from_file(JSON), token_files.library_encoder(JSON)
    texts = SHORT + random_texts(500, "ab cdeé 日🤗.\n\t\r=,thing  12'sll", 40)
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = [rng.integers(0, 50_257, n).astype(np.uint32), np.array([0], np.uint32),
               np.where(rng.random(700) < 0.03, 4_000_000_000, 5).astype(np.uint32)]
        data = token_files.pack_segment([1, 2, 3], ids)
        keys, lengths, back = token_files.unpack_segment(data)
        assert keys.tolist() == [1, 2, 3] and lengths.tolist() == [n, 1, 700]
        assert (back == np.concatenate(ids)).all()
        assert (token_files.unpack_segment(data, block=1)[2] == np.concatenate(ids)[512:1024]).all()


def test_token_files(spark):
    lib = Tokenizer.from_file(JSON)
    ids = [30, 10, 20, 40, 40, 1, 2, 3, 4, 5, 6]
    path = scratch(spark, "t")
    token_files.write_token_files(documents(spark, EDGE, ids), JSON, path)
    rows = token_files.read_token_files(spark, path).collect()
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.read_checksums(spark, path).collect()}
    at = 0
    texts = sorted(zip(ids, (t or "" for t in EDGE)), key=lambda x: x[0])
    for r, (i, t) in zip(sorted(rows, key=lambda r: r["start"]), texts):
        assert (r["doc_id"], r["start"]) == (i, at)
        if i != 40:
            assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids + [0]
        assert sums[i, at] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert len(rows) == len(EDGE)
    empty = scratch(spark, "t")
    token_files.write_token_files(documents(spark, []), JSON, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_null_ids_come_first(spark):
    path = scratch(spark, "t")
    token_files.write_token_files(documents(spark, ["a", "b b", "c"], [-5, None, 7]), JSON, path)
    rows = sorted(map(tuple, token_files.read_token_files(spark, path).select("start", "doc_id", "n_tokens").collect()))
    assert rows == [(0, None, 3), (3, -5, 2), (5, 7, 2)]


def test_digest_queries(spark, tik):
    from postlens.llm.queries import LLM_QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in LLM_QUERIES["op2_byte_bpe"](spark, d).collect():
        ids = np.array(tik.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_a_file_writer_is_bounded(spark, monkeypatch):
    """Two workers beside a heap of 1.8 GB in 3 GB: each its words in two halves
    and the arrays of one gathering."""
    seen = []

    class Encoder:
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return [np.zeros(1, "<u4") for _ in texts]

    def encoder(path, kept_bytes=token_files.KEPT_BYTES):
        seen.append(-kept_bytes)
        return Encoder()

    monkeypatch.setattr(token_files, "library_encoder", encoder)
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    batch = pa.table({"key": range(2000), "text": ["x" * 10_000] * 2000}).to_batches()
    assert sum(r["n_tokens"][0].as_py() for r in token_files._segments(iter(batch), "model", 0)) == 4000
    kept, gathered = -seen[0], max(seen)
    assert 2 * (2 * kept + 40 * gathered) < (3000 << 20) * 0.4 * 0.8


def test_kept_words_stay_in_their_bytes():
    encoder = token_files.LibraryEncoder(JSON, kept_bytes=1 << 20)
    rng = np.random.default_rng(3)
    for _ in range(12):
        encoder.encode([" ".join("".join(w) for w in rng.choice(list("abcdefgh"), (3000, 8)))])
        held = sum(len(w) + len(i) + token_files.ENTRY_BYTES for d in (encoder._ids, encoder._older) for w, i in d.items())
        assert held < 2 * (1 << 20) + 2 * 3000 * (token_files.ENTRY_BYTES + 60)
