"""Classifier, top-k search, mixing and the pipeline on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
from lanepulse.llm import mixing, quality, queries, topk
from lanepulse.staging import stage


def test_scores_separate_held_out_labels_and_take_odd_rows(spark):
    rng = random.Random(6)
    good = ["report", "method", "result", "measure", "careful", "study"]
    bad = ["click", "buy", "free", "win", "now", "cheap"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
    rows = [(i, text(good if i % 2 else bad), "s", 0.5) for i in range(240)]
    rows += [(900, None, None, None), (901, "", "s", 1.0), (None, "no id", "s", 1.0), (3, "again", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(3)
    marks = [(i, i % 2) for i in range(240)] + [(900, 1), (None, 1), (5, None), (7, 0), (8888, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["id"] is not None and r["id"] < 240 and r["id"] != 3
            and zlib.crc32(str(r["id"]).encode()) % 4 == 2]
    assert len(held) > 30 and sum((r["score"] >= 0.5) == r["id"] % 2 for r in held) >= 0.95 * len(held)
    assert len({r["score"] for r in got if r["id"] in (900, 901)}) == 1
    kept = quality.with_score(docs, model).collect()
    assert sorted(r["score"] for r in kept) == sorted(r["score"] for r in got)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    blank = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, blank).collect()} == {0.5}


def test_top_k_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, rng.random())) for _ in range(6)], i) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(40)]
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    odd = [(2000, None, 0), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2100, [float("nan")] * 6, 0),
           (2150, [1.0], 0), (None, [1.0] * 6, 0), (2200, [float("inf")] * 6, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int").repartition(4)
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    for cells in ({}, {"cell_rows": 9, "query_rows": 2}):
        got = {tuple(r) for r in topk.top_k(df, **cells).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 50")).count() == 0


def _copies(name, rate, parts):
    n = 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{name}|{j}|mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < mixing.TERMS:
            k += 1
            p *= rate / parts / k
            c += p
            n += 1
    return n


def test_mixing_equals_inversion_by_hand(spark):
    rows = [(i, "big", "t", 1) for i in range(200)] + [(1000 + i, "small", "t", 1) for i in range(4)]
    rows += [(2000, None, None, 1), (None, "big", "", 1), (5, "big", "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int").repartition(3)
    for weights in (None, {"big": 1.0, "small": 9.0}):
        rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, weights=weights).collect()}
        want = Counter()
        for ident, source, text, _ in rows:
            rate = rates[source or ""]
            n = _copies("null" if ident is None else ident, rate, max(math.ceil(rate / mixing.PART), 1))
            want.update({(ident, source, text, k): 1 for k in range(1, n + 1)})
        got = mixing.mix(df, weights=weights).collect()
        assert Counter((r["doc_id"], r["source"], r["text"], r["copy"]) for r in got) == want
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_decisions(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    passage = words(60)
    rows = [(i, f"{words(50)}\n{passage}" if i % 3 == 0 else words(80), "en", "s%d" % (i % 2), 0, "x") for i in range(30)]
    rows += [(100 + i, rows[1][1], "en", "s0", 0, "x") for i in range(5)]
    rows += [(200, None, None, None, None, None), (201, "", "en", "s0", 0, "x"), (None, words(30), "en", "s1", 0, "x")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string"
    docs = spark.createDataFrame(rows, columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    made = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        made.append(docs.collect())
        if k < 4:
            assert docs.columns == [c.split(" ")[0] for c in columns.split(", ")]
    assert len(made[1]) == len({(r["doc_id"]) for r in made[0]} - set(range(100, 105)))
    holders = [r["doc_id"] for r in made[2] if passage in (r["text"] or "")]
    assert holders == [min(r["doc_id"] for r in made[1] if passage in (r["text"] or ""))]
    assert {r["row_key"] for r in made[4]} and len({(r["row_key"]) for r in made[4]}) == len(made[3])
    assert sum(r["length"] for r in made[4] if r["start"] == 0) <= sum(r["doc_tokens"] for r in made[4])


def test_fit_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.with_score(docs, quality.fit_quality(docs, labels), "s").count() == 0


def test_last_stage_holds_the_token_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three " * 900), (2, None), (None, "four")], "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert len({r["row_key"] for r in rows}) == 3
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


def test_mixing_query_carries_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, "text %d" % i, "en", "s%d" % (i % 3), 6) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    monkeypatch.setattr(queries, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    got = queries.op8_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "rate", "n_copies", "copy", "shuffle_key"]
    whole = written[0].collect()
    assert len(whole) == got.count() > 0
    assert all((r["text"], r["lang"], r["n_chars"]) == ("text %d" % r["doc_id"], "en", 6) for r in whole)
