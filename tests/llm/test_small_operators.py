"""Archives, resharding, fingerprints and paragraphs on small tables with odd rows."""

from __future__ import annotations

import random
from collections import Counter

from lanepulse.llm import fingerprints, reshard, substring_dedup, warc


def test_archives_round_trip(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\nv", None), (4, "u", ""), (None, "u", "x"), (4, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, manifest = warc.write_archives(df)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert {r["kind"] for r in got} == {"record"} and len(got) == len(rows)
    by = Counter((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert by[(1, 9, "response", None)] == 1 and by[(2, 9, "revisit", 1)] == 1
    assert by[(3, 0, "response", None)] == 1 and by[(4, 0, "revisit", 3)] == 1
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 9} == {warc.base32_sha1("<p>é</p>".encode())}


def test_salvage_recovers_later_records_and_logs_gaps():
    def member(k):
        body = b"payload %d" % k * 50
        return warc._member(warc.record(k, k, "u", body, warc.base32_sha1(body), k, k))

    parts = [member(k) for k in range(6)]
    plain = warc.record(9, 9, "u", b"plain", warc.base32_sha1(b"plain"), 9, 9)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    wrong = plain.replace(b"plain\r\n\r\n", b"plane\r\n\r\n")
    data = parts[0] + bytes(broken) + b"noise" + parts[1] + parts[3][:-4] + plain + wrong + parts[4] + parts[5][:20]
    found = list(warc.salvage(data))
    assert [w["id"] for k, _, _, w in found if k == "record"] == [0, 1, 9, 4]
    ends = 0
    for _, offset, length, _ in found:
        assert offset == ends
        ends = offset + length
    assert ends == len(data) and sum(k == "gap" for k, *_ in found) == 4
    assert list(warc.salvage(b"")) == []


def test_flow_moves_least_and_shards_are_gapless(spark):
    flow = reshard.min_cost_flow([10, 2, 0], [4, 4, 4], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [10, 2, 0] and [sum(c) for c in zip(*flow)] == [4, 4, 4]
    assert sum(flow[i][i] for i in range(3)) == 6
    assert sorted(reshard.capacities([90, 5, 5], 3)) == [5, 5, 90]
    rng = random.Random(1)
    rows = [(i, "t%d" % rng.randrange(300) * 9, 0) for i in range(900)] + [(None, None, 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = reshard.reshard(df).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    homes = {}
    for r in got:
        homes.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in homes.values())
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(Counter(
        {k: k[0] * sum((r["size"], r["text_crc32"]) == k for r in got) for k in homes}).values())
    assert reshard.reshard(df.limit(0)).count() == 0


def test_extensions_and_edits(spark):
    a, b = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in ("abcdefgh", "xxcdefgz"))
    assert a.extension(2, b, 2) == 5 and a.extension(0, b, 0) == 0
    assert a.spans(2, 5) == b.spans(2, 5) and a.spans(2, 5) != b.spans(3, 6)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é\U0001f600") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(3 * i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    for size in (8 << 20, 2000):
        got = {r["id"]: r for r in fingerprints.fingerprint(df, range_bytes=size).collect()}
        order = [t or "" for _, t, _ in rows]
        for k, (ident, text, _) in enumerate(rows):
            text, after = text or "", order[(k + 1) % len(order)]
            half = len(text) // 2
            want = text[: len(text) - half] + after[:half]
            import hashlib

            assert got[ident]["n_chars"] == len(text)
            assert got[ident]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert 0 <= got[ident]["near_edited"] <= 1 and 0 <= got[ident]["near_next"] <= 1
        assert got[0]["fingerprint"] == got[1001]["fingerprint"] and got[1001]["near_next"] == 1.0
    assert fingerprints.fingerprint(df.limit(0)).count() == 0


def test_repeated_paragraphs_go_and_clean_lines_stay(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    passage, short = line(60), line(6)
    near = passage.replace(passage.split(" ")[30], "changed", 1)
    clean = [line(40) for _ in range(4)]
    rows = [(k, f"{clean[k]}\n{short}\n{p}", 3) for k, p in enumerate((passage, near, passage, line(60)))]
    rows += [(9, None, 0), (None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["id"]: r for r in substring_dedup.remove_paragraphs(df).collect()}
    assert [got[k]["removed"] for k in (0, 1, 2, 3)] == [[], [2], [2], []]
    assert got[2]["kept"] == f"{clean[2]}\n{short}" and got[9]["kept"] is None
    kept = {r["doc_id"]: r for r in substring_dedup.with_kept_text(df).collect()}
    assert kept[2]["text"] == got[2]["kept"] and kept[2]["n_chars"] == len(got[2]["kept"])


def test_passages_inside_across_and_wrapped_over_lines_go(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("w%d" % rng.randrange(9000) for _ in range(n))
    passages = [words(51 + k) for k in range(12)]
    split = lambda p, n: "\n".join(" ".join(p.split()[i : i + n]) for i in range(0, len(p.split()), n))
    shapes = [lambda p: p, lambda p: split(p, 30), lambda p: split(p, 9)]
    rows, want = [(k, f"{words(70)} {p} {words(70)}") for k, p in enumerate(passages)], {}
    for k, p in enumerate(passages):
        before, after = words(80), words(80)
        rows.append((100 + k, f"{before} {shapes[k % 3](p)} {after}"))
        want[100 + k] = [before.split(), after.split()]
    run, own = " ".join(["ha"] * 40), words(60)
    rows += [(300, f"{words(30)} {own} {words(30)} {own} {words(30)}"), (301, run), (302, words(40) + " é\n\n ü"), (303, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["id"]: r for r in substring_dedup.remove_paragraphs(df).collect()}
    for k, (before, after) in want.items():
        assert got[k]["kept"].split() == before + after
    assert all(got[k]["kept"] == t for k, t in rows if k < 100 or k > 300)
    assert got[300]["kept"].count(own) == 1 and len(got[300]["kept"].split()) == 150
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.with_kept_text(df).collect()}
    assert kept == {k: r["kept"] for k, r in got.items()}


def test_cut_spans_take_their_white_space_and_emptied_lines():
    text = " a b  c d\ne f\n\ng h "
    assert substring_dedup.without(text, [], [1], [3]) == (" a d\ne f\n\ng h ", [])
    assert substring_dedup.without(text, [], [2, 3], [3, 7]) == (" a b\n\nh ", [1])
    assert substring_dedup.without(text, [1], [0], [1]) == (" b  c d\n\ng h ", [1])
    assert substring_dedup.without(text, [0], [], []) == ("e f\n\ng h ", [0])


def test_rewritten_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "text %d" % i, "en") for i in range(200)] + [(None, "a", "x"), (None, None, "y"), (7, "again", "z"), (7, "text 7", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    folder = f"{tmp_path}/shards"
    stay = reshard.F.lit(None).cast("int")
    for old_shards, shards in ((1, 6), (6, 2)):
        plan = reshard.reshard(docs, old_shards=old_shards, shards=shards).cache()
        if old_shards == 6:
            # The layout so far, by the shards that the second plan starts from.
            whole = plan.select("id", "key", reshard.F.col("old_shard").alias("shard"), stay.alias("slot"))
            whole.write.mode("overwrite").partitionBy("shard").parquet(folder)
        touched = reshard.rewrite(docs, plan, folder)
        assert set(touched) >= {r["shard"] for r in plan.where("old_shard <> shard").collect()}
        got = spark.read.parquet(folder)
        assert {r["shard"] for r in got.select("shard").distinct().collect()} <= set(range(shards))
        assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == Counter(rows)


def test_reshard_query_reads_rewritten_shards(spark, tmp_path):
    from lanepulse.llm import queries

    rows = [(i, "text %d " % i * (i % 40), "en") for i in range(400)] + [(None, "a", "x"), (7, None, "y"), (7, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    result = queries.op10_reshard(spark, str(tmp_path))
    assert len({f.split("/")[-2] for f in result.inputFiles() if "/shard=" in f}) == reshard.SHARDS
    assert not any("documents.parquet" in f for f in result.inputFiles())
    names = ("size", "text_crc32", "old_shard", "shard", "slot")
    plan = reshard.reshard(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert Counter(tuple(r) for r in result.select("doc_id", *names).collect()) == Counter(
        tuple(r) for r in plan.select("id", *names).collect())
    # One text stays where it is: no file is rewritten, and its rows have their slots.
    same = spark.createDataFrame([(i, "same", "en") for i in range(9)], docs.schema)
    held = reshard.resharded(same, f"{tmp_path}/one")
    assert sorted(r["slot"] for r in held.collect()) == list(range(9))
    assert {r["shard"] for r in held.collect()} == {r[0] for r in same.select(reshard.hashed_shard(reshard.F.col("text"))).collect()}
    assert reshard.resharded(docs.limit(0), f"{tmp_path}/none").count() == 0


def test_words_around_are_marked_for_the_joins_that_ask_for_them():
    import pyarrow as pa

    asked = [[{"at": 2, "own": True, "ref": False}, {"at": ~2, "own": False, "ref": True}]]
    batch = pa.RecordBatch.from_pydict({"key": [7], "text": ["a b c d"], "asked": asked})
    (got,) = substring_dedup._edges([batch])
    rows = got.to_pylist()
    assert [(r["at"], r["own"], r["ref"], len(r["words"])) for r in rows] == [(2, True, False, 2), (~2, False, True, 2)]
    ours, theirs = rows[1]["words"], rows[1]["words"] + rows[0]["words"]
    begun = pa.RecordBatch.from_pydict({
        "key": [7], "start": [2], "stop": [30], "ref_key": [3], "ref_stop": [40], "words": [ours], "ref_words": [theirs],
    })
    assert next(substring_dedup._begun([begun])).to_pylist() == [
        {"key": 7, "start": 0, "stop": 30, "ref_key": 3, "ref_stop": 40}]
