"""Neighbours, chat lines, packing and row numbers, against plain versions."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import ann, chat, packing
from postlens.llm.numbering import number_rows

from .conftest import EDGE, documents

SF = "/root/testdata/sf0.01"


def plain_neighbours(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        other = [j for j in range(len(ids)) if ids[j] != ids[i]]
        score = {j: float((x[j] * x[i]).sum()) for j in other}
        out[ids[i]] = [ids[j] for j in sorted(other, key=lambda j: (-score[j], ids[j]))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in centres] + [rng.normal(size=(600, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(ann.neighbours(df)), plain_neighbours(list(range(len(x))), x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(75, 16)) for c in centres])
    x *= np.exp(rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(ann.neighbours(df)), plain_neighbours(list(range(len(x))), x, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    sizes = np.bincount(ann.balanced_parts(ann.nearest(x, 10), 16))
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 0.5]), (20, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (40, [0.0, 0.0]),
            (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("part", F.lit("p"))
    assert found(ann.neighbours(df)) == {0: [1, 2, 3, 20], 20: [3, 0, 1, 2]}  # ties to the smaller id
    assert ann.neighbours(df.where("false")).count() == 0
    assert ann.neighbours(df.where("vec_id = 5")).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (3000, 1)), rng.normal(size=(300, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert found(ann.neighbours(df, every=500))[0] == list(range(1, 21))


MESSAGES = "conv_id long, turn long, role string, content string, call_id string, name string, arguments string, needs array<string>"
SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False,
                   "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}}}}


def chats(spark, rows):
    got = chat.format_chats(spark.createDataFrame(rows, MESSAGES).withColumn("node", F.lit(1)), SCHEMAS).collect()
    return sorted(got, key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"]))


def test_links_order_and_lines(spark):
    rows = [(1, 0, "user", "hi", None, None, None, None),
            (1, 1, "tool", "7", "k1", None, None, None),  # the result stands before its call
            (1, 2, "assistant", None, "k1", "add", '{"b": 4.0, "a": 3}', None),
            (1, 3, "assistant", "", "k2", "add", '{"a": 1, "b": -1}', ["k1"]),
            (1, 4, "tool", "?", "nobody", None, None, None),
            (2, 0, "assistant", None, "k1", "sub", "{}", None),
            (2, 1, "assistant", None, "k3", "add", "not json", None),
            (2, 2, "assistant", None, "k3", "add", '{"a": 1, "b": 2, "c": 3}', None),
            (2, 3, "tool", "ä\n\"", "k3", None, None, None),
            (None, None, None, None, None, None, None, None)]
    got = chats(spark, rows)
    assert [(r["conv_id"], r["turn"], r["status"], r["args_valid"]) for r in got] == [
        (None, None, "plain", None),
        (1, 0, "plain", None), (1, 2, "answered", True), (1, 1, "linked", None), (1, 3, "unanswered", False),
        (1, 4, "orphan", None),
        (2, 0, "unanswered", False), (2, 1, "ambiguous", False), (2, 2, "ambiguous", False), (2, 3, "ambiguous", None)]
    lines = {(r["conv_id"], r["turn"]): r["line"] for r in got}
    assert lines[1, 2] == '{"role":"assistant","tool_call":{"arguments":{"a":3,"b":4},"id":"k1","name":"add"}}'
    assert lines[2, 1] == '{"role":"assistant","tool_call":{"arguments":"not json","id":"k3","name":"add"}}'
    assert lines[2, 3] == '{"content":"ä\\n\\"","role":"tool","tool_call_id":"k3"}'
    assert lines[None, None] == "{}"


def test_cycle_and_empty(spark):
    rows = [(1, 0, "a", None, "x", "add", "{}", ["y"]), (1, 1, "a", None, "y", "add", "{}", ["x"]),
            (1, 2, "t", "1", "x", None, None, None), (1, 3, "t", "2", "y", None, None, None),
            (1, 4, "a", None, "z", "add", "{}", ["none"])]
    got = chats(spark, rows)
    assert len(got) == 5 and [r["turn"] for r in got] == [0, 1, 2, 3, 4]
    assert {r["status"] for r in got[:4]} == {"cyclic"} and got[4]["status"] == "unanswered"
    assert chats(spark, []) == []


@pytest.mark.parametrize("newest_first", [False, True])
def test_long_chain_is_no_cycle(spark, newest_first):
    rows = []
    for i in range(100):  # 200 messages, each after the one before
        turns = (-2 * i, -2 * i - 1) if newest_first else (5, 5)
        rows += [(1, turns[0], "a", None, f"k{i:03}", "add", "{}", [f"k{i - 1:03}"] if i else None),
                 (1, turns[1], "t", str(i), f"k{i:03}", None, None, None)]
    rows = [rows[i] for i in np.random.default_rng(0).permutation(200)]
    got = chats(spark, rows)
    assert [(r["call_id"], r["status"]) for r in got] == [
        (f"k{i:03}", s) for i in range(100) for s in ("answered", "linked")]


def test_branches_and_followers_of_a_cycle(spark):
    call = lambda turn, k, needs: (1, turn, "a", None, k, "add", "{}", needs)
    result = lambda turn, k: (1, turn, "t", k, k, None, None, None)
    rows = [call(0, "x", ["y"]), call(1, "y", ["x"]), result(2, "x"), result(3, "y"),  # a cycle
            call(0, "f", ["y"]), result(0, "f"), call(0, "g", ["f", "z"]), result(0, "g"),  # what follows it
            call(9, "z", None), result(9, "z"), call(0, "d", ["z", "b"]), call(0, "b", ["z"]), result(0, "b"), result(0, "d"),
            call(4, "p", ["g", "q"]), call(4, "q", ["p"]), result(4, "p"), result(4, "q")]  # a second cycle after both
    got = chats(spark, rows)
    place = {(r["call_id"], r["status"] in ("linked",) or r["role"] == "t"): r["position"] for r in got}
    assert {r["call_id"] for r in got if r["status"] == "cyclic"} == {"x", "y", "p", "q"} and len(got) == len(rows)
    for k, needs in (("f", "y"), ("g", "fz"), ("b", "z"), ("d", "zb")):
        assert all(place[n, True] < place[k, False] for n in needs) and place[k, False] < place[k, True]


def test_schema_words():
    assert chat.valid([1, 2], {"type": "array", "items": {"type": "integer"}, "maxItems": 2})
    assert not chat.valid([1, "2"], {"type": "array", "items": {"type": "integer"}})
    assert not chat.valid(True, {"type": "integer"}) and chat.valid(2.0, {"type": "integer"})
    assert not chat.valid("abc", {"maxLength": 2}) and chat.valid(None, {"type": ["null", "string"]})
    assert not chat.valid(3, {"enum": [1, 2]}) and not chat.valid({"a": 1}, {"required": ["b"]})


@pytest.mark.parametrize("good, bad, schema", [
    ("ab1", "ab", {"pattern": "[0-9]$"}),
    (3, "x", {"anyOf": [{"type": "integer"}, {"type": "null"}]}),
    (3, 6, {"oneOf": [{"multipleOf": 3}, {"multipleOf": 2}]}),
    (3, 9, {"allOf": [{"minimum": 1}, {"maximum": 5}]}),
    (3, "x", {"not": {"type": "string"}}),
    ({"a": {"a": {}}}, {"a": {"a": 1}}, {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}}}}),
    (1.5, 1, {"exclusiveMinimum": 1}),
    (1.5, 2, {"exclusiveMaximum": 2}),
    (0.3, 0.35, {"multipleOf": 0.1}),
    ([1, True, "1"], [1, 1.0], {"uniqueItems": True}),
    ({"x1": 1}, {"x1": "a"}, {"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}),
    ({"b": 1}, {"b": "1"}, {"additionalProperties": {"type": "integer"}}),
    ([1, "a"], ["a", 1], {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}),
    ({"a": 1, "b": 2}, {"a": 1}, {"dependentRequired": {"a": ["b"]}}),
    (5, -5, {"if": {"type": "integer"}, "then": {"minimum": 0}}),
    (1, True, {"enum": [1]}),
])
def test_more_schema_words(good, bad, schema):
    assert chat.valid(good, schema) and not chat.valid(bad, schema)


def test_unknown_schema_words_raise(spark):
    for schema in ({"patern": "x"}, {"properties": {"a": {"unevaluatedItems": False}}}, {"$ref": "http://x/y"},
                   {"$ref": "#/$defs/none"}, {"$ref": "#"}, {"minimum": 1, "exclusiveMinimum": True}):
        with pytest.raises(ValueError):
            chat.valid(1, schema)
    with pytest.raises(ValueError):
        chat.format_chats(spark.createDataFrame([], MESSAGES), {"add": {"dependentSchemas": {}}})
    assert chat.valid(1, {"title": "t", "description": "d", "format": "int32", "default": 0})


def test_query_lines_are_json(spark):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    got = chat.format_chats(chat.exchanges(talks), chat.REPLY)
    assert got.count() == talks.count()
    for r in got.limit(200).collect():
        assert chat.canonical(json.loads(r["line"])) == r["line"]


def test_numbers_of_a_large_group(spark):
    rng = np.random.default_rng(0)
    rows = [(None if g == 3 else int(g), int(v)) for g, v in zip(rng.choice([0, 0, 0, 0, 1, 2, 3, 9], 5000), rng.permutation(5000))]
    got = number_rows(spark.createDataFrame(rows, "g int, v int"), ["g"], ["v"], "n").collect()
    want = {}
    for g in {g for g, _ in rows}:
        for n, v in enumerate(sorted(v for h, v in rows if h == g)):
            want[g, v] = n
    assert {(r["g"], r["v"]): r["n"] for r in got} == want
    assert number_rows(spark.createDataFrame([], "g int, v int"), ["g"], ["v"], "n").count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        histogram = {int(x): int(c) for x, c in zip(rng.choice(np.arange(1, 60), 9, replace=False), rng.integers(1, 50, 9))}
        lengths = sorted(histogram)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram.items())

        for buckets in (1, 3, 20):
            got = packing.best_boundaries(histogram, buckets)
            assert len(got) <= buckets and got[-1] == lengths[-1]
            want = min(padding((*some, lengths[-1])) for k in range(min(buckets, 9))
                       for some in itertools.combinations(lengths[:-1], k))
            assert padding(got) == want
    assert packing.best_boundaries({}, 4) == []


def test_pack(spark):
    rng = np.random.default_rng(5)
    lengths = [(i, int(n)) for i, n in enumerate(rng.integers(1, 400, 300))] + [(7, 30), (None, 5), (500, 1000), (501, 0), (502, None)]
    df = spark.createDataFrame(lengths, "key long, length long").withColumn("bucket", F.lit("x"))
    got = packing.pack(df, longest=256, buckets=4, budget=1024).collect()
    total = {}
    for r in got:
        total[r["key"]] = total.get(r["key"], 0) + r["n_tokens"]
        assert r["start"] == 256 * r["piece"] and 0 < r["n_tokens"] <= min(256, r["bucket_length"])
        assert 0 <= r["slot"] < max(1, 1024 // r["bucket_length"])
    want = {}
    for i, n in lengths:
        if n:
            want[i] = want.get(i, 0) + n
    assert total == want
    places = sorted((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert len(set(places)) == len(places)
    for bucket, rows in itertools.groupby(places, lambda p: p[0]):
        rows = list(rows)
        full = {b: sum(1 for r in rows if r[1] == b) for _, b, _ in rows}
        assert sorted(full) == list(range(len(full)))  # only the last batch is not full
        assert len(set(list(full.values())[:-1])) <= 1
    assert packing.pack(df.where("false")).count() == 0


def test_lengths_of_edge_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r["key"]: r["length"] for r in packing.token_lengths(documents(spark, EDGE), path).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(EDGE)}


@pytest.fixture(scope="module")
def staged(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    from postlens.llm.common import stored
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def test_pipeline(spark, staged):
    from .test_dedup import plain_groups, plain_repeats

    docs, clean, good, single, cut, packed = staged
    for a in staged[1:5]:
        assert a.columns == docs.columns
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in clean.collect()}
    gone = [labels[r["doc_id"]]["toxic"] for r in docs.collect() if r["doc_id"] not in left and r["doc_id"] in labels]
    assert gone and np.mean(gone) > 0.9
    best = {r["doc_id"] for r in good.collect()}
    assert all(labels[i]["quality"] == 1 for i in best if i in labels and i not in (None,)) or np.mean(
        [labels[i]["quality"] for i in best if i in labels]) > 0.97
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    groups = plain_groups([i for i, _ in rows], [t for _, t in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in groups})
    before = sorted((r["doc_id"], (r["text"] or "").encode()) for r in single.collect())
    after = {r["doc_id"]: r for r in cut.collect()}
    for (i, raw), mask in zip(before, plain_repeats(before, 100)):
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)
    tokens = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert tokens.keys() == after.keys()


@pytest.mark.parametrize("arguments", ["[" * 100_000, '{"text":' * 3000, '{"a":"\\ud800"}', '{"a":1e400}', '{"a":NaN}', "[-Infinity]",
                                       "1" * 10_000, "", "nope", None])
def test_arguments_that_are_no_json_stay_text(arguments):
    value, ok = chat.read_arguments(arguments, {"type": ["object", "array", "number", "string"]})
    assert (value, ok) == (arguments, False)
    json.loads(chat.canonical({"arguments": value}), parse_constant=lambda c: pytest.fail(c))


def test_odd_arguments_do_not_end_the_job(spark):
    odd = ["[" * 100_000, '{"a":"\\ud800"}', '{"a":1e400}', '{"a":NaN}']
    rows = [(1, i, "user", None, f"c{i}", "add", a, []) for i, a in enumerate(odd)]
    got = chat.format_chats(spark.createDataFrame(rows, MESSAGES), SCHEMAS).orderBy("turn").collect()
    assert [r["args_valid"] for r in got] == [False] * 4
    assert [json.loads(r["line"])["tool_call"]["arguments"] for r in got] == odd
