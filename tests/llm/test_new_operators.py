"""Hard negatives, licence scans and periodic runs against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanepulse.llm import hard_negatives, license_scan, periodic_runs, queries, substring_dedup, topk

DOCS = "doc_id long, text string"


def plain_runs(words, least=12):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q) and i > start:
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def tricky_words(rng, n):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        loop = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        words = (loop * 200)[:n]
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = "x"
        return words
    if kind == 3:
        x, y = ["a"], ["a", "b"]
        while len(y) < n:
            x, y = y, y + x
        return y[:n]
    if kind == 4:
        return (["a", "b", "c"] * 40)[: rng.randint(3, 40)] * 3
    return ((["a"] * rng.randint(1, 20) + ["b"]) * 20)[rng.randint(0, 10):][:n]


@pytest.mark.parametrize("least", [6, 9, 12, 31])
def test_runs_are_those_of_every_period_tried(least):
    rng = random.Random(least)
    for _ in range(120):
        docs = [tricky_words(rng, rng.randint(0, 110)) for _ in range(rng.randint(1, 6))]
        numbers = np.array([ord(w) for d in docs for w in d], np.int64)
        document = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        start, end, period = periodic_runs.runs_of(numbers, document, least)
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in plain_runs(d, least)]
            at += len(d)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want


def test_wavelet_tree_counts_and_orders_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletTree(values)
        low = rng.integers(0, n, 50)
        high = low + rng.integers(1, n + 1, 50)
        high = np.minimum(high, n)
        limit = rng.integers(0, n + 3, 50)
        assert tree.below(low, high, limit).tolist() == [
            int((values[a:b] < x).sum()) for a, b, x in zip(low, high, limit)
        ]
        nth = rng.integers(0, high - low)
        assert tree.nth(low, high, nth).tolist() == [
            int(np.sort(values[a:b])[k]) for a, b, k in zip(low, high, nth)
        ]


def plain_op13(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + floor((n - a) / (3 + g % 8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


OP13 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op13_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(5)
    space = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n"]
    docs = [(i, "".join(w + rng.choice(space) for w in tricky_words(rng, rng.randint(0, 90)))) for i in range(160)]
    docs += [(900, None), (901, ""), (902, " a " * 30), (903, "ß é " * 20), (904, "\x1c \x85 " * 20)]
    spark.createDataFrame(docs, DOCS).withColumn("id", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*OP13).collect())) == sorted(plain_op13(*d) for d in docs)


def test_op13_on_the_sample(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d["text"] or "") < 4000]
    want = {d["doc_id"]: plain_op13(*d) for d in docs}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, folder).select(*OP13).collect()}
    assert want and all(got[k] == v for k, v in want.items())


def test_runs_of_one_document_do_not_depend_on_its_chunk(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(tricky_words(rng, 100))) for i in range(60)], DOCS)
    small = periodic_runs.periodic_runs(docs, chunk_words=1)
    large = periodic_runs.periodic_runs(docs)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)


def test_a_long_text_is_one_run_and_ids_may_be_null_or_repeated(spark):
    docs = spark.createDataFrame([(None, "a b c " * 100_000), (1, "x"), (1, "y " * 12), (None, None)], DOCS)
    rows = {(r["id"], r["n_words"]): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows[None, 300_000]["runs"]] == [(0, 300_000, 3)]
    assert rows[None, 300_000]["collapsed"] == "a b c" and rows[1, 12]["collapsed"] == "y"
    assert rows[1, 1]["runs"] == [] and rows[None, 0]["collapsed"] == ""
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(3, np.int64), np.zeros(3, np.int64), 5)


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_op12(key, text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [
        (i, label) for phrase, label in BASE.items() for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (key, len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def license_texts():
    rng = random.Random(2)
    bits = ["under", "the", "MIT", "license", "apache License,", "Version 2", "version", "2.0", "CC", "BY-NC", "nc",
            "by", "cc by nc", "é", "ü-the", " ", "\n", "license:", "MIT OR", "(", ")", "2", "under the mit license"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(200)]
    return list(enumerate([*texts, None, "", "cc-by-nc " * 2000, "UNDER\x00THE\x7fMIT~License"]))


def test_op12_base_equals_the_plain_version(spark, tmp_path):
    docs = license_texts()
    spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit("clash")).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = queries.op12_licenses(spark, str(tmp_path)).collect()
    base = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows]
    assert sorted(base) == sorted(plain_op12(*d) for d in docs)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "" or r["expressions"] != "")


def test_op12_on_the_sample(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_licenses(spark, folder).collect()
    base = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows]
    assert sorted(base) == sorted(plain_op12(*d) for d in docs)
    assert {"gpl-3", "mit", "apache-2", "cc-by-nc"} <= {r["labels"] for r in rows}


@pytest.mark.parametrize("text, postfix, needed, restricts, whole", [
    ("mit", "mit", "mit", 1, True),
    ("mit or gpl-3.0 and isc", "mit gpl-3.0 isc and or", "mit", 1, True),
    ("(mit or gpl-3.0-only) and isc", "mit gpl-3.0-only or isc and", "isc,mit", 1, True),
    ("gpl-2.0+ with classpath-exception-2.0", "gpl-2.0+ classpath-exception-2.0 with", "gpl-2", 2, True),
    ("gpl-2.0 with x and mit", "gpl-2.0 x with mit and", "gpl-2,mit", 2, True),
    ("agpl-3.0 or\nmit", "agpl-3.0", "agpl-3", 3, False),
    ("(mit and (isc", "mit isc and", "isc,mit", 1, False),
    ("mit and (", "mit", "mit", 1, False),
    ("mit) or isc", "mit", "mit", 1, False),
    ("own-licence", "own-licence", "own-licence", 4, True),
    ("and mit", "", None, None, True),
    ("()", "", None, None, False),
    ("", "", None, None, True),
])
def test_licence_expressions(text, postfix, needed, restricts, whole):
    read = license_scan.parse(text)
    assert " ".join(read.postfix) == postfix and read.whole == whole
    value = license_scan.evaluate(read.postfix, True)
    if needed is None:
        assert value is None
    else:
        assert (",".join(sorted(value.needed)), value.restricts) == (needed, restricts)


def test_brackets_nest_deeply_and_chains_are_long():
    deep = license_scan.parse("(" * 50_000 + "mit" + ")" * 50_000)
    assert deep.postfix == ["mit"] and deep.whole
    chain = license_scan.parse(" and ".join(f"own-{i}" for i in range(20_000)))
    assert len(license_scan.evaluate(chain.postfix, True).needed) == 20_000


def test_tags_are_read_where_they_stand(spark):
    texts = [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LicenseRef-Own\nmore", "License: this is prose",
        "sublicense: MIT", "License: MIT and then", "spdx-license-identifier:", None,
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = {r["id"]: r for r in license_scan.license_columns(license_scan.scan_licenses(docs)).collect()}
    assert rows[0]["labels"] == "apache-2,licenseref-own,mit" and rows[0]["score"] == 1.0
    assert rows[0]["needed_labels"] == "licenseref-own,mit"
    assert [rows[i]["labels"] for i in (1, 2, 4, 5)] == [""] * 4 and rows[1]["score"] == 0.0
    assert rows[3]["labels"] == "mit" and rows[3]["score"] == 0.25
    assert rows[6]["labels"] == "gpl-3,mit" and rows[6]["score"] == 0.5
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


def plain_mine(rows, every=50, positives=5, negatives=3):
    def good(label, v):
        return label is not None and v is not None and all(x is not None and isfinite(x) for x in v)

    held = [(i, label, [floor(256 * int(x)) if abs(x) > 2**60 else floor(256 * x) for x in v])
            for i, label, v in rows if i is not None and good(label, v)]
    out = []
    for i, label, v in held:
        if i % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in held if j != i and len(w) == len(v)
        )
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, j) for n, j, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, pid, r + 1, j, -p, -n) for r, (n, j) in enumerate(fits[:negatives])]
    return sorted(out)


ROWS = "vec_id long, label int, embedding array<double>"


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).withColumn("key", F.lit("clash")).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, **options).collect()))


@pytest.mark.parametrize("width, scale, blocks", [
    (3, 1, 16384), (3, 1, 13), (16, 0.05, 40), (4, 1e6, 40), (4, 1e9, 16384), (1, 0.01, 13),
])
def test_hard_negatives_equal_the_plain_version(spark, width, scale, blocks):
    rng = random.Random(width * 7 + blocks)
    rows = [
        (i, rng.choice([0, 0, 0, 1, 2, 3]), [rng.gauss(0.2, 1) * scale for _ in range(width)]) for i in range(260)
    ]
    rows += [(300 + i, i % 3, rows[5][2]) for i in range(60)]  # ties
    if scale == 1e9:
        # Scores near 4e22 do not fit: the job stops instead of giving other numbers.
        with pytest.raises(Exception, match="too (big|large)"):
            mined(spark, rows, every=20, block_rows=blocks)
        return
    got = mined(spark, rows, every=20, block_rows=blocks, anchor_rows=5 if blocks < 100 else 16384)
    want = plain_mine(rows, every=20)
    assert want and got == want


def test_hard_negatives_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 1.0]), (1, 1, [0.5, 1.0]), (2, 2, [0.5, 0.5]), (3, 2, [0.0, 0.9]), (3, 2, [0.9, 0.0]),
        (3, 2, [0.9, 0.0]), (4, 1, None), (5, 2, [float("nan"), 1.0]), (6, 2, [None, 1.0]), (7, None, [1.0, 1.0]),
        (None, 2, [1.0, 1.0]), (8, 2, [1.0]), (9, 1, [2.0]), (50, 1, []), (51, 1, []), (52, 2, []), (100, 3, [1.0, 1.0]),
        (150, 1, [-1.0, -1.0]), (200, 1, [0.0, 0.0]), (10, 2, [float("inf"), 0.0]), (11, 2, [0.4, 0.4]),
    ]
    assert mined(spark, rows) == plain_mine(rows)
    assert (50, 51, 1, 52, 0, 0) in mined(spark, rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(5000, 2)))
    lists = hard_negatives.SortedLists(rows)
    steps = list(lists.scan(np.array([256.0, -40.0])))
    assert steps[-1][2] is None and sum(len(s[0]) for s in steps) == 5000
    seen = 0
    for found, scores, threshold in steps:
        seen += len(found)
        if threshold is not None:
            rest = np.setdiff1d(np.arange(5000), np.concatenate([s[0] for s in steps])[:seen])
            assert (rows[rest] @ np.array([256.0, -40.0])).max(initial=-np.inf) <= threshold
    ids = np.arange(5000)
    (places, best), = hard_negatives.best_in_windows(
        lists, np.array([256.0, -40.0]), ids, np.ones(5000, bool), [(None, None)], 5
    )
    assert best.tolist() == sorted(rows @ np.array([256.0, -40.0]), reverse=True)[:5]


@pytest.mark.parametrize("scale", [1, 1e6, 1e-3])
def test_top_k_is_exact_for_large_components_shared_ids_and_other_widths(spark, scale):
    rng = random.Random(4)
    vector = lambda n: [rng.gauss(0.3, 1) * scale for _ in range(n)]
    rows = [(i, vector(8)) for i in range(260)] + [(i, vector(8)) for i in (3, 3, 100, 77)]
    rows += [(500 + i, vector(3)) for i in range(60)] + [(700, []), (701, []), (750, vector(5)), (50, None)]
    whole = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).repartition(3)
    for cells in ({}, {"cell_rows": 17, "query_rows": 2}):
        got = topk.top_k(df, **cells).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_passages_with_a_changed_word_go_at_every_place(spark):
    rng = random.Random(3)
    words = lambda n: ["w%d" % rng.randrange(9000) for _ in range(n)]
    rows, exact, near = [], {}, {}
    for length in (51, 60, 90, 200):
        for at in range(0, length, max(1, length // 25)):
            k, passage = len(near), words(length)
            rows.append((k, " ".join(words(70) + passage + words(70))))
            changed = list(passage)
            if at % 3 == 0:
                changed[at] = "changed"
            elif at % 3 == 1:
                changed.insert(at, "added")
            else:
                del changed[at]
            before, after = words(80), words(80)
            rows.append((10_000 + k, " ".join(before + changed + after)))
            near[10_000 + k] = len(before) + len(after)
            before, after = words(33), words(90)
            rows.append((20_000 + k, "\n".join([" ".join(before + passage[:30]), " ".join(passage[30:] + after)])))
            exact[20_000 + k] = before + after
    df = spark.createDataFrame(rows, DOCS).withColumn("found", F.lit("clash")).repartition(4)
    got = {r["id"]: r["kept"] for r in substring_dedup.remove_paragraphs(df).collect()}
    assert all(got[k].split() == kept for k, kept in exact.items())
    # A change close to an edge leaves the words beyond it.
    left = [len(got[k].split()) - kept for k, kept in near.items()]
    assert max(left) <= substring_dedup.RESUME and left.count(0) >= 0.8 * len(left)
    assert all(got[k] == t for k, t in rows if k < 10_000)


@pytest.mark.parametrize("a, b, want", [
    ("abcdefgh", "abcdefgh", (8, 8)), ("abxdefghi", "abydefghi", (9, 9)), ("abdefghi", "abxdefghi", (8, 9)),
    ("abxdefghi", "abdefghi", (9, 8)), ("abxdefg", "abydefg", (2, 2)), ("", "abc", (0, 0)), ("xabcdef", "yabcdef", (7, 7)),
    ("abcde", "fghij", (0, 0)),
])
def test_words_that_agree_by_edits(a, b, want):
    code = lambda t: np.array([ord(c) for c in t], np.int32)
    assert substring_dedup.agreeing(code(a), code(b)) == want
