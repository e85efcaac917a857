"""Near-duplicate groups against all pairs compared on full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lanepulse.llm import kernels as K
from lanepulse.llm import linking, minhash_near, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, threshold):
    sets = {k: shingle_set(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                hi, lo = sorted((find(a), find(b)), reverse=True)
                parent[hi] = lo
    return {k: (len(sets[k]), find(k)) for k in sets}


def sample(n, seed):
    rng = random.Random(seed)
    line = lambda k: " ".join("w%d" % rng.randrange(400) for _ in range(k))
    base, rows = line(120), []
    for key in range(n):
        kind = rng.random()
        words = base.split(" ")
        if kind < 0.5:
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = "e%d" % rng.randrange(1000)
            text = " ".join(words)
        elif kind < 0.6 and rows:
            text = rng.choice(rows)[1].upper().replace(" ", "\n\t")
        elif kind < 0.7:
            text = line(rng.randint(0, 5))
        else:
            text = line(rng.randint(5, 150))
        rows.append((key, text))
    rows += [(n, ""), (n + 1, " \n"), (n + 2, "One"), (n + 3, "one"), (n + 4, "é É")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_groups_equal_brute_force(spark, size):
    rows = sample(250, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {
        r["id"]: (r["n_shingles"], r["group_id"])
        for r in minhash_near.near_groups(df, size=size).collect()
    }
    assert got == brute(rows, size, 80)


def test_leftovers_in_small_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "PART_ROWS", 7)
    monkeypatch.setattr(linking, "PART_SHINGLES", 900)
    monkeypatch.setattr(linking, "PROGRESS", 0)
    rows = sample(250, 11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {
        r["id"]: (r["n_shingles"], r["group_id"])
        for r in minhash_near.near_groups(df).collect()
    }
    assert got == brute(rows, 5, 80)


def test_nulls_ties_and_clashing_columns(spark):
    text = "one two three four five six"
    rows = [(None, text, 1), (7, text, 2), (7, text, 3), (8, None, 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = minhash_near.near_groups(df).collect()
    assert len(got) == 5
    linked = [r for r in got if r["n_shingles"]]
    assert len({r["group_key"] for r in linked}) == 1 and len(linked) == 3
    assert {r["group_id"] for r in got if not r["n_shingles"]} == {8, 9}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_near.near_groups(df).count() == 0


def test_words_match_pattern():
    texts = ["  a b", "", "x", "\x1f y\x0b\x0cz ", "é ü"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end, doc = K.words(data, offsets)
    got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(start, end, doc)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]


@pytest.mark.parametrize("threshold", [40, 60, 79, 101])
def test_thresholds_that_nothing_is_tuned_for_are_refused(spark, threshold):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for run in (minhash_near.near_groups, minhash_near.first_of_groups, substring_dedup.remove_paragraphs):
        with pytest.raises(ValueError):
            run(df, threshold=threshold)
