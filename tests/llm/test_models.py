"""Quality classifier, suffix tree, search and chat formatting."""

import collections
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, quality, suffix_tree, topk
from tests.llm import helpers

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_the_words():
    bodies = [b"", b" The THE\tcat\x0bsat ", b"\n", "çà the Cat".encode(), b"x" * 5000]
    h, at = quality.word_hashes(bodies)
    words = [b.lower().split() for b in bodies]
    assert np.diff(at).tolist() == [len(w) for w in words]
    named = collections.defaultdict(set)
    for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True):
        named[w].add(x)
    assert all(len(v) == 1 for v in named.values()) and len(set.union(*named.values())) == len(named)


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1025)
    bodies = [b"a b a c", b"", b"one", "ä b c d e f g a b".encode()]
    got = quality.scores(bodies, weights)
    for body, s in zip(bodies, got, strict=True):
        idx, _ = quality.ngram_slots([body], 1024)
        slots, counts = np.unique(idx, return_counts=True)
        dot = weights[slots] @ quality.values(counts.astype(float)) if len(slots) else 0.0
        assert math.isclose(s, 1 / (1 + math.exp(-(weights[-1] + dot))), rel_tol=1e-12)


def test_quality_on_held_out_documents(spark):
    got = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got) / len(got)
    pairs = [(a.score > b.score) for a in got for b in got if a.quality > b.quality]
    assert right > 0.88 and sum(pairs) / len(pairs) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, "good fine" if i % 2 else "bad ***") for i in range(40)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs, turned))


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1), (6, 5)], "doc_id bigint, quality int")
    docs = helpers.odd(spark)
    weights = quality.fit(docs, labels)
    got = quality.score(docs, weights).collect()
    assert len(got) == len(helpers.odd_rows()) and all(0 <= r.score <= 1 for r in got)
    kept = quality.accepted(docs, weights, 0.0)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    nothing = quality.fit(helpers.empty(spark), labels)
    assert not nothing.any() and quality.accepted(helpers.empty(spark), nothing).count() == 0


def _tree_rows(spark, docs):
    training = suffix_tree.texts(docs.where(~suffix_tree.held_out()))
    counts = suffix_tree.materialise(suffix_tree.word_counts(training))
    tree = suffix_tree.fit(training, counts)
    return tree, suffix_tree.score(docs, tree, counts)


def test_suffix_tree_base_scores(spark):
    _, scored = _tree_rows(spark, helpers.odd(spark))
    rows = helpers.odd_rows()
    split = [(t or "").encode().lower().split() + [b""] for _, t, *_ in rows]
    c = collections.Counter(w for (i, *_), ws in zip(rows, split, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(c.values())
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), 6)) for (i, *_), ws in zip(rows, split, strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.collect())
    assert got == want
    _, none = _tree_rows(spark, helpers.empty(spark))
    assert none.count() == 0


def test_suffix_tree_is_a_distribution_and_predicts(spark):
    rng = random.Random(4)
    follow = {"a": "bbbc", "b": "aacd", "c": "ddda", "d": "abcd"}

    def text():
        w = [rng.choice("abcd")]
        for _ in range(rng.randint(20, 60)):
            w.append(rng.choice(follow[w[-1]]) if len(w) < 2 or w[-2] != "d" else "d")
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id bigint, text string")
    tree, scored = _tree_rows(spark, docs)
    assert len(tree.contexts[0]) and len(tree.contexts[1])
    rows = scored.where(suffix_tree.held_out()).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 20 * len(rows) * 0.1
    index = tree.index()
    for past in (["a"], ["d", "a"], ["b", "zzz"], []):
        total = 0.0
        for nxt in [*tree.vocab, b"never seen"]:
            ids = np.array([index.get(w.encode(), -1) for w in past] + [index.get(nxt, -1)])
            shares, open_ = tree.log_shares(ids, np.arange(len(ids)))
            base = tree.base[ids[-1]] if ids[-1] >= 0 else -math.log10(tree.total + tree.distinct + 1)
            total += 10 ** (shares[-1] + (base if open_[-1] else 0.0))
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def plain_search(rows, queries, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted(queries):
        qv = next((v for i, v in fine if i == q), None)
        if qv is None:
            continue
        best = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(qv)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("scale", [0.2, 3e6])
def test_topk_with_ties_and_bad_vectors(spark, scale):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=6) * scale).astype(np.float32).tolist()) for i in range(90)]
    vectors += [(100 + i, vectors[3][1]) for i in range(30)]
    vectors += [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (None, vectors[0][1]), (204, [1.0, 2.0]), (206, [0.5, 0.5]), (205, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    scaled = topk.scaled(df)
    got = topk.search(scaled, scaled.where(F.col("vec_id") % 4 == 0), 7, vector_block=16, query_block=5).collect()
    assert sorted(tuple(r) for r in got) == plain_search(vectors, [i for i, _ in vectors if i is not None and i % 4 == 0], 7)
    assert topk.search(scaled.where("false"), scaled.where("false"), 7).count() == 0


def _schemas(spark):
    return chat.tool_schemas(spark)


def test_chat_links_orders_and_validates(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "search", '{"turn": 1, "query": "x"}'), (1, 5, "a", "search", "{}"), (1, 3, "b", "search", '{"query": 7, "more": [1, {"z": 1, "b": null}]}'),
        (1, 4, "c", "nope", '{"b":1,"a":"\\u00e9"}'), (2, 1, "a", "lookup", "not json"), (None, 1, "a", "search", None), (2, 2, None, "lookup", '{"turn":2,"query":"q","page":1}'),
        (3, 1, "p", "search", "[]"), (3, 2, "q", "search", "[]"),
    ], "conv_id bigint, turn bigint, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 0, "a", "early"), (1, 9, "a", "again"), (1, 2, "b", "r"), (2, 3, "zz", None), (3, 3, "p", "1"), (3, 4, "q", "2")], "conv_id bigint, turn bigint, call_id string, content string")
    messages = spark.createDataFrame([(1, 0, "user", "hi \"you\"\n"), (1, 0, "user", "hi \"you\"\n"), (None, None, None, None)], "conv_id bigint, turn bigint, role string, content string")
    depends = spark.createDataFrame([(1, "b", "c"), (3, "p", "q"), (3, "q", "p"), (1, "c", "missing")], "conv_id bigint, call_id string, needs string")
    rows = chat.format_chat(calls, results, messages, _schemas(spark), depends).collect()
    by = {(r.conv_id, r.kind, r.call_id): r for r in rows}
    assert len(rows) == 16
    assert by[1, "call", "a"].errors == [] and by[1, "call", "b"].errors == ["missing:turn", "type:query", "unknown:more"]
    assert by[1, "call", "c"].errors == ["unknown_tool"] and by[2, "call", "a"].errors == ["no_object"] and by[None, "call", "a"].errors == ["no_object"]
    assert by[2, "call", None].errors == [] and by[2, "call", None].status == "no_result"
    assert by[1, "call", "b"].json == '{"arguments":{"more":[1,{"b":null,"z":1}],"query":7},"id":"b","name":"search","role":"assistant"}'
    assert by[1, "call", "c"].json == '{"arguments":{"a":"é","b":1},"id":"c","name":"nope","role":"assistant"}'
    assert (by[1, "result", "a"].at, by[1, "result", "a"].depth) == (1, 1) and json.loads(by[1, "result", "a"].json)["content"] == "early"
    assert by[2, "result", "zz"].status == "no_call" and by[1, "call", "c"].status == "no_result"
    assert all(by[3, kind, i].cyclic for kind in ("call", "result") for i in "pq") and not by[1, "call", "b"].cyclic
    place = lambda r: (r.at, r.depth)
    assert place(by[1, "call", "b"]) < place(by[1, "result", "b"])
    none = chat.format_chat(*(t.where("false") for t in (calls, results, messages)), _schemas(spark), depends.where("false"))
    assert none.count() == 0


def test_chat_tells_what_has_an_identifier_met_before(spark):
    calls = spark.createDataFrame([(1, 5, "a", "n", "{}"), (1, 1, "a", "n", "x"), (1, 5, "a", "n", "{}"), (1, 2, "b", "n", None), (None, 1, "a", "n", "x"), (None, 1, "a", "n", "x")], "conv_id bigint, turn bigint, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 7, "a", "r"), (1, 7, "a", "r"), (2, 1, "a", None)], "conv_id bigint, turn bigint, call_id string, content string")
    got = sorted((r.conv_id, r.call_id, r.kind, r.json) for r in chat.repeated(calls, results).collect())
    assert got == [(1, "a", "call", '{"arguments":"{}","name":"n","turn":5}')] * 2 + [(1, "a", "result", '{"content":"r","turn":7}')]
    empty = [spark.createDataFrame([], s) for s in ("conv_id bigint, turn bigint, role string, content string", "conv_id bigint, call_id string, needs string")]
    rows = chat.format_chat(calls, results, empty[0], _schemas(spark), empty[1]).collect()
    assert sorted((r.kind, r.call_id, r.extra) for r in rows if r.conv_id == 1) == [("call", "a", 2), ("call", "b", 0), ("result", "a", 1)]
    assert "ShuffledHashJoin" in chat.link(calls, results)._jdf.queryExecution().toString()


def test_a_null_text_does_not_end_the_cutting_of_batches():
    import pyarrow as pa

    from folio.llm.common import blocks

    batch = pa.RecordBatch.from_arrays([pa.array([None, *["x" * 10] * 100], pa.string())], names=["text"])
    assert [b.num_rows for b in blocks(iter([batch]), "text", 50)] == [6, *[5] * 19]


def test_topk_of_any_finite_vector(spark):
    rows = [(0, [1e15, 0.0]), (1, [1e15, 1.0]), (2, [-3e38, 2.0]), (3, [2.0**34, 2.0**34 + 1 / 64]), (4, [3e38, 1e30]), (20, [3e38, -3e38]), (5, [0.25, 1.0]), (40, [0.5, 0.5]), (40, [9.0, 9.0]), (60, [-1e300, 1e300]), (80, [900.0, 16000.0]), (81, [1.7e308 / 64, 1.7e308 / 64])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    scaled = topk.scaled(df)
    got = topk.search(scaled, scaled.where("vec_id % 20 = 0"), 5, vector_block=4, query_block=2, text=True).orderBy("query_id", "rank").collect()
    whole = [(i, [math.floor(64 * x) if abs(x) < 1e14 else int(64 * x) for x in v]) for i, v in rows]
    asked = {0: whole[0][1], 20: whole[5][1], 40: whole[7][1], 60: whole[9][1], 80: whole[10][1]}
    want = []
    for q, qv in asked.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in whole if i != q)[:5]
        want += [(q, n + 1, i, -s if -(2**63) <= -s < 2**63 else None, str(-s)) for n, (s, i) in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_topk_blocks_do_not_pass_the_driver(spark):
    df = spark.createDataFrame([(i, [i / 64.0, (i * 7 % 11) / 64.0]) for i in range(60)], "vec_id bigint, embedding array<double>")
    scaled = topk.scaled(df)
    found = topk.search(scaled, scaled.where("vec_id % 20 = 0"), 3, vector_block=8, query_block=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim" in plan and "BroadcastHashJoin [dim" not in plan
    assert found.count() == 9


def test_topk_looks_at_few_whole_scores(spark, monkeypatch):
    """The share test decides which scores are resolved: without it every entry is."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "vec_id bigint, embedding array<double>")
    ids, v = np.arange(400), np.floor(64 * np.array([r.embedding for r in vectors.orderBy("vec_id").collect()]))
    resolved = []
    monkeypatch.setattr(topk, "_best", lambda rows, flat, got, k, plain=topk._best: (resolved.append(len(got)), plain(rows, flat, got, k))[1])
    scores = (v[:20] @ v.T).astype(np.int64)
    np.fill_diagonal(scores, -(2**60))
    cuts = [int(np.sort(s)[-10]) for s in scores]
    batch = topk._tile(ids[:20], v[:20], ids, v, cuts, 10)
    assert sorted(zip(batch.column("query_id").to_pylist(), batch.column("score").to_pylist(), strict=True)) == sorted((q, int(s)) for q in range(20) for s in np.sort(scores[q])[-10:])
    topk._tile(ids[:20], v[:20], ids, v, [None] * 20, 10)
    assert resolved[1] == 20 * 399 and resolved[0] < 20 * 30


def test_chat_order_of_a_chain_told_backwards(spark):
    n = 12
    nodes = spark.createDataFrame([(1, f"n{i}", n - i) for i in range(n)], "conv_id bigint, node string, turn bigint")
    depends = spark.createDataFrame([(1, f"n{i + 1}", f"n{i}") for i in range(n - 1)] + [(1, "n0", "absent")], "conv_id bigint, node string, needs string")
    rows = chat.ordered(nodes, depends).orderBy("at", "depth").collect()
    assert [r.node for r in rows] == [f"n{i}" for i in range(n)] and not any(r.cyclic for r in rows)
