"""Operators on vectors, pages and conversations, and the pipeline, with the hard cases."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import docs_frame, documents, with_clashes
from tickloom.llm import fixity, tool_calls, topk

# --- 6: top-k ---------------------------------------------------------------------------


def vectors():
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(0, 0.1, 7).tolist()) for i in range(300)]
    same = draw.normal(0, 0.2, 7).tolist()
    rows += [(i, same) for i in range(300, 400)]  # one vector in a fourth of the rows
    rows += [(400 + i, [float(x) for x in draw.integers(-1, 2, 7) / 8]) for i in range(60)]  # ties
    rows += [(460, None), (461, []), (462, [0.1, None] + [0.0] * 5), (463, [float("nan")] * 7)]
    rows += [(464, [float("inf")] + [0.0] * 6), (None, same), (501, [1.0, 2.0]), (500, [0.5, 0.5])]
    rows += [(50, rows[50][1]), (100, [0.3] * 7)]  # a repeated row, and an id with two vectors
    return rows


def plain_top(rows, every, k):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault((i, tuple(math.floor(256 * float(np.float32(c))) for c in x)), 0)
            v[i, tuple(math.floor(256 * float(np.float32(c))) for c in x)] += 1
    out = set()
    for q, a in v:
        if q % every == 0:
            best = {}
            for j, b in v:
                if j != q and len(a) == len(b):
                    best.setdefault((j, sum(x * y for x, y in zip(a, b))))
            top = sorted(best, key=lambda t: (-t[1], t[0]))[:k]
            out |= {(q, j, s) for j, s in top}
    return out


@pytest.mark.parametrize("sizes", [(4096, 1024), (37, 3)])
def test_topk_equals_all_products(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CHUNK", sizes[0])
    monkeypatch.setattr(topk, "BLOCK", sizes[1])
    rows = vectors()[:-2]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("own"))
    q = topk.quantised(frame)
    found = topk.search(q, q.filter("vec_id % 50 = 0"), 5).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in found} == plain_top(rows, 50, 5)
    for i in {r["query_id"] for r in found}:
        own = sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))


def test_topk_of_repeated_ids_and_nothing(spark):
    frame = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<float>")
    q = topk.quantised(frame)
    found = topk.search(q, q.filter("vec_id % 50 = 0"), 5).collect()
    assert {r["query_id"] for r in found} == {50 * k for k in range(11)}
    assert all(r["query_id"] != r["vec_id"] for r in found)
    none = q.limit(0)
    assert topk.search(none, none, 5).count() == 0


# --- 1: fixity --------------------------------------------------------------------------

PAGE = "page_id bigint, url string, html string"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(0, 9000, 7)]
    return rows + [(None, None, None), (-5, "u", None), (14, "again", "x"), (14, "again", "x"), (10**9, "far", "é" * 4000)]


def test_fixity_finds_each_difference(spark):
    left = pages()
    right = [r for r in left if r[0] != 21]
    right[5] = (right[5][0], right[5][1], right[5][2] + "!")
    right.append((22, "new", "y"))
    right.remove((14, "again", "x"))
    frame = lambda rows: spark.createDataFrame(rows, PAGE).withColumn("hash", F.lit("own"))
    found = {r["page_id"]: r for r in fixity.audit(frame(left), frame(right)).collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        21: "missing",
        right[5][0]: "changed",
        22: "extra",
        14: "changed",
    }
    assert len({(r["root_a"], r["root_b"]) for r in found.values()}) == 1
    assert all(r["root_a"] != r["root_b"] for r in found.values())
    assert found[22]["offset_a"] is None and found[22]["bytes_b"] > 0
    assert fixity.audit(frame(left), frame(left[::-1])).count() == 0
    lost = fixity.audit(frame(left), frame([])).collect()
    assert {r["status"] for r in lost} == {"missing"} and len(lost) == len({r[0] if r[0] is not None else -1 for r in left})
    assert fixity.audit(frame([]), frame([])).count() == 0


# --- 3: tool calls ----------------------------------------------------------------------

CALL = "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>"
ANSWER = "conv_id bigint, call_id string, turn bigint, content string"
SCHEMA = {"f": {"x": ("integer", True), "s": ("string", False)}}


def test_calls_are_linked_ordered_checked_and_written(spark):
    calls = [
        (1, "a", 1, "f", '{"x": 1.0, "s": "é\\n"}', []),
        (1, "b", 3, "f", '{"s": 2, "z": [true, null, {"k": 1e2, "a": 0.5}]}', ["a"]),
        (1, "c", 2, "f", "{broken", ["b", "a", "nowhere"]),
        (1, "d", 5, "g", "{}", None),
        (1, "e", 6, "f", '{"x": true}', ["h"]),
        (1, "h", 7, "f", '{"x": 2}', ["e"]),
        (1, "i", 8, "f", '{"x": 3}', ["h"]),
        (1, "a", 9, "f", '{"x": 9}', []),
        (2, "a", 1, "f", '{"x": 1, "x": 2}', []),
        (2, None, 1, "f", None, None),
        (None, "a", None, None, "[]", None),
        (3, "a", 1, "f", '{"x": NaN}', []),
    ]
    answers = [
        (1, "a", 4, "later"),
        (1, "a", 2, "first"),
        (1, "zz", 1, None),
        (2, "a", 2, "r" * 50_000),
        (4, "a", 1, "other"),
        (None, None, None, None),
    ]
    found = tool_calls.link(
        spark.createDataFrame(calls, CALL).withColumn("status", F.lit("own")),
        spark.createDataFrame(answers, ANSWER).withColumn("level", F.lit("own")),
        SCHEMA,
    ).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in found}
    assert len(found) == 14
    status = {k: r["status"] for k, r in by.items()}
    assert status[1, "a"] == "linked" and status[1, "zz"] == status[4, "a"] == "orphan"
    assert status[1, "b"] == "unanswered" and status[2, None] == "unnamed"
    level = {k[1]: r["level"] for k, r in by.items() if k[0] == 1}
    assert level == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "h": None, "i": None, "zz": None}
    assert (by[1, "a"]["copies"], by[1, "a"]["answers"], by[1, "a"]["result_turn"]) == (2, 2, 2)
    assert by[1, "a"]["findings"] == [] and by[1, "a"]["valid"]
    assert by[1, "b"]["findings"] == ["s: not string", "x: missing", "z: unknown"]
    assert by[1, "c"]["findings"] == ["malformed arguments", "after nowhere: unknown call"]
    assert by[1, "d"]["findings"] == ["unknown tool"]
    assert by[1, "e"]["findings"] == ["x: not integer", "on or behind a cycle"]
    assert by[2, "a"]["findings"] == ["malformed arguments"] == by[3, "a"]["findings"]
    assert by[1, "a"]["json"] == (
        '{"call":{"after":[],"arguments":{"s":"é\\n","x":1},"name":"f"},"conversation":1,"findings":[],'
        '"id":"a","result":"first","status":"linked"}'
    )
    assert '"z":[true,null,{"a":0.5,"k":100}]' in by[1, "b"]["json"]
    for r in found:
        assert tool_calls.canonical(json.loads(r["json"])) == r["json"]


def test_turns_become_calls(spark):
    draw = random.Random(1)
    rows = []
    for c in range(12):
        for t in range(draw.randint(1, 12)):
            words = [draw.choice(['"q"', "a\\b", "é", "x"]) for _ in range(draw.randint(0, 30))]
            rows.append((c, t, "assistant" if t % 2 else draw.choice(["user", None]), " ".join(words)))
    rows += [(50, 1, "assistant", None), (None, 1, "assistant", "x"), (51, None, None, "y"), rows[3], rows[3]]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    calls, results = tool_calls.turns_as_calls(turns.withColumn("word", F.lit("own")))
    found = tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()
    assert not [r for r in found if "malformed arguments" in r["findings"]]
    named = {(r[0], r[1]) for r in rows if r[2] == "assistant" and None not in r[:2]}
    assert {(r["conv_id"], int(r["call_id"][5:])) for r in found if r["status"] in ("linked", "unanswered")} == named
    for r in found:
        if r["status"] in ("linked", "unanswered"):
            t = r["turn"]
            deep = 0
            while t % 8 >= 4 and (r["conv_id"], t - 2) in named:
                deep, t = deep + 1, t - 2
            assert r["level"] == deep
    none = turns.limit(0)
    assert tool_calls.link(*tool_calls.turns_as_calls(none), tool_calls.SCHEMAS).count() == 0


# --- the pipeline -------------------------------------------------------------------------


def test_pipeline_over_hard_cases(spark, tmp_path):
    import corpus_pipeline

    rows = documents()
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    passage = " ".join(rows[0][1].split()[3:20])
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == names
        kept[name] = docs.collect()
    ids = {name: sorted(r["doc_id"] for r in found if r["doc_id"] is not None) for name, found in kept.items()}
    by = {name: {r["doc_id"]: r for r in found} for name, found in kept.items()}
    letterless = {138, 139, 140, 141}
    assert set(ids["language"]) == set(range(146)) - letterless
    # clean documents are left alone by every stage
    for i in range(20, 100):
        for name in list(kept)[:4]:
            assert by[name][i]["text"] == rows[i][1]
    # copies: their lines stay in the first alone
    assert 126 in by["lines"] and not {127, 128, 129} & set(ids["lines"])
    assert len(ids["near duplicates"]) == len(set(ids["near duplicates"]))
    assert passage not in by["decontamination"][0]["text"]
    assert by["decontamination"][0]["n_chars"] == len(by["decontamination"][0]["text"])
    assert ids["tokens"] == ids["decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()
    assert sorted(map(repr, whole)) == sorted(repr(r) for r in docs.select("doc_id", "ids_sha256").collect())


def test_pipeline_over_nothing(spark, tmp_path):
    import corpus_pipeline

    docs_frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, tmp_path):
    import corpus_pipeline

    rows = documents()[120:]
    docs = with_clashes(docs_frame(spark, rows))
    found = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 5 in ids and 126 in ids and not {127, 128, 129} & set(ids)
    assert sum(r["doc_id"] is None for r in found) == 2
