"""Repeated strings against a brute-force count of every window."""

from __future__ import annotations

import hashlib
import random

import pytest

from lanepulse.llm import suffix_dedup


def brute(rows):
    order = sorted(rows, key=lambda r: r[0])
    seen, out = {}, {}
    for key, text in order:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], key)
    for key, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def sample(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [line(20) for _ in range(4)]
    rows = []
    for key in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind < 0.6:
            text = line(rng.randint(0, 30)) + rng.choice(passages) + line(rng.randint(0, 30))
        elif kind < 0.65:
            text = "a" * rng.randint(40, 400)
        else:
            text = line(rng.randint(0, 80))
        rows.append((key, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 49), (n + 3, "x" * 50), (n + 4, "y" + "x" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [(8 << 20, 16 << 20), (3000, 2000)])
def test_removed_bytes_equal_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", parts)
    rows = sample(150, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {
        r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in suffix_dedup.remove_repeats(df).collect()
    }
    assert got == brute(rows)


def test_repeated_and_missing_ids_and_clashing_columns(spark):
    text = "the same long passage of words that goes on for more than fifty bytes"
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (3, "other", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r["id"] or -1, r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()))
    assert got == [(-1, 0), (3, 0), (3, len(text)), (3, len(text))]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0
