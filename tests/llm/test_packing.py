"""Token pieces against the tokenizer on whole texts, and first fit against a plain scan."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lanepulse.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "  ", "The the THE the, the. the.. it's IT'S", "ΣΑΣ Σ σας. İstanbul é É,", "<|endoftext|> <|EndOfText|>",
    "a\x1fb c\td\r\ne", "x" * 5000, "word " * 5000, "don't. we'll, 12.5% ...", "ǅ ﬁ ª ² ½ १२",
]


def test_ids_equal_whole_text_encoding():
    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD]
    words = packing.Encoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in words.encode(texts)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_bound_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    test_ids_equal_whole_text_encoding()


def test_first_fit_equals_scan():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 2048) for _ in range(500)), reverse=True)
    room, want = [], []
    for size in sizes:
        k = next((i for i, r in enumerate(room) if r >= size), len(room))
        if k == len(room):
            room.append(2048)
        room[k] -= size
        want.append(k)
    assert packing.first_fit(sizes, 2048) == want
    assert packing.first_fit([], 2048) == []


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    rng = random.Random(9)
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join("w%d" % rng.randrange(99) for _ in range(rng.randint(0, 900))), 0) for i in range(80)]
    rows += [(None, "no id", 0), (100, "again", 0), (100, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    by_row, by_sequence = {}, {}
    for r in got:
        by_row.setdefault(r["key"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    seen = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        ids = b"".join(r["ids"] for r in pieces)
        assert len(ids) == 4 * pieces[0]["doc_tokens"]
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in pieces)
        seen.append((pieces[0]["id"], np.frombuffer(ids, "<u4").tolist()))
    want = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0, *(r["length"] for r in pieces)])
        assert [r["offset"] for r in pieces] == ends[:-1].tolist() and ends[-1] <= 2048


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH).count() == 0
