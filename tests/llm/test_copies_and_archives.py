import base64
import glob
import gzip
import hashlib
import json
import math
import os
import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, ego_join, ngram_join, shingles, warc
from ledgerloom.llm.common import scratch_path
from ledgerloom.llm.components import connected_components

from .conftest import make_docs, sentence


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def least_reachable(nodes, links):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def components_by_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, least_reachable(ids, links)


def test_shingle_sets_count_words():
    texts = ["a b c d e f", "A\tb\nC d E f", None, "", " ", "x", "é É é É é", "a b c d e f"]
    got = [len(s) for s in shingles.batch_sets(pa.array(texts))]
    assert got == [len(shingle_set(t)) for t in texts]
    sliced = pa.array(["zz", *texts]).slice(1)
    assert [s.tolist() for s in shingles.batch_sets(sliced)] == [s.tolist() for s in shingles.batch_sets(pa.array(texts))]


def test_suffix_filter_loses_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 4000, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 4000, rng.integers(0, 60)).astype(np.uint64)]))
        if len(y):
            common = len(np.intersect1d(x, y))
            assert ngram_join.linked(x, y) == (100 * common >= 80 * (len(x) + len(y) - common))


def test_jaccard_components(spark, docs, no_docs):
    rows = [(r[0], r[1]) for r in make_docs()]
    sets, want = components_by_force(rows)
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert ngram_join.jaccard_components(no_docs).count() == 0
    unnamed = spark.createDataFrame([(None, rows[3][1]), (None, rows[3][1]), (None, "a text of its own and more")], "doc_id long, text string")
    out = ngram_join.jaccard_components(docs.select("doc_id", "text").union(unnamed)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want | {None: None} and len(out) == len(rows) + 3
    again = ngram_join.jaccard_components(docs.union(docs)).collect()
    assert len(again) == 2 * len(rows) and all(want[r["doc_id"]] == r["component_id"] for r in again)


def test_jaccard_chains_and_stragglers(spark):
    """A hot group in which many pairs miss the threshold still ends in the right components."""
    rng = random.Random(4)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    _, want = components_by_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == want


def test_connected_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    want = least_reachable({n for e in links for n in e}, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in set(want) - set(got))


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.15, base[:5], base[:5] * 3]))]
    hot = rng.normal(size=16)
    rows += [(100 + i, (hot + rng.normal(size=16) * 0.16).tolist()) for i in range(120)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1.0, None])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), rows + odd


def test_embedding_join_equals_brute_force(spark):
    df, rows = vectors(spark)
    unit = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], np.float32).astype(np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    low = least_reachable([i for i, _ in rows], links)
    n = Counter(a for a, _ in links)
    unnamed = df.where("vec_id IN (0, 100)").selectExpr("CAST(NULL AS LONG) AS vec_id", "embedding")
    for size in (2, 8, 1024):  # 2: more than 64 blocks and several tiles
        found = ego_join.near_duplicates(df.union(unnamed), block_rows=size).collect()
        assert [(r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is None] == [(0, None, False)] * 2
        got = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
        assert {i: r["n_links"] for i, r in got.items()} == {i: n[i] for i, _ in rows}
        assert {i: r["component_id"] for i, r in got.items()} == low
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert ego_join.near_duplicates(df.limit(0)).count() == 0


def test_block_recursion_skips_only_distant_blocks(spark):
    rng = np.random.default_rng(8)
    boxes = [(int(b), 4, sorted_low.tolist(), (sorted_low + rng.random(4)).tolist()) for b, sorted_low in zip(rng.choice(200, 50, replace=False), rng.normal(size=(50, 4)) * 3)]
    df = spark.createDataFrame(boxes, "block long, width int, low array<double>, high array<double>")
    got = {(r["i"], r["j"]) for r in ego_join.block_pairs(df, 0.5, 8).collect()}
    want = set()
    for a, _, la, ha in boxes:
        for b, _, lb, hb in boxes:
            gap = sum(max(x - w, y - z, 0) ** 2 for x, z, y, w in zip(la, ha, lb, hb))
            if a <= b and gap <= 0.25:
                want.add((a, b))
    assert got == want and len(want) < 50 * 51 // 2


PAGES = [(i, f"http://x/{i}", t) for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>\r\n\r\nWARC/1.1"])] + [(50, None, "<p>b</p>"), (51, "http://a\r\nb", "z" * 200000)]


@pytest.mark.parametrize("always64,member_bytes,zip_members,files", [(False, 8 << 20, 8, 1), (True, 100, 8, 2), (False, 100, 2, 5)])
def test_warc_round_trip(spark, monkeypatch, always64, member_bytes, zip_members, files):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, path, member_bytes=member_bytes, zip_members=zip_members, always64=always64)
    assert len(glob.glob(path.replace("file://", "") + "/part-*")) == files
    rows = warc.read_archives(spark, path).collect()
    got = {r["page_id"]: r for r in rows}
    with monkeypatch.context() as m:  # as on a store that only Spark reaches
        m.setattr(warc, "_by_range", lambda path: False)
        assert sorted(warc.read_archives(spark, path).collect(), key=str) == sorted(rows, key=str)
    first = {}
    for i, _, h in PAGES:
        first.setdefault(h or "", i)
    for i, _, h in PAGES:
        data = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    for f in glob.glob(path.replace("file://", "") + "/part-*"):
        with zipfile.ZipFile(f) as z:  # another reader finds the same members
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_warc_limits_and_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "a" * 50), (4, "u", "a" * 50), (4, "u", "a" * 50), (None, "u", "a" * 50)], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, min_bytes=10)
    assert Counter((r["page_id"], r["record_type"]) for r in warc.read_archives(spark, path).collect()) == Counter({(1, "response"): 1, (2, "response"): 1, (3, "response"): 1, (4, "revisit"): 2, (None, "revisit"): 1})
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_damage_is_found(spark):
    record = warc._record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert warc.parse_record(record)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"hello", b"hallo"))
    with pytest.raises(ValueError):
        warc.zip_members(5, lambda at, n: b"hello"[at : at + n])


def foreign_record(kind, record_id, payload, **more):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" if kind in ("response", "revisit") else b""
    block = http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": f"http://x/{record_id}", "Content-Length": str(len(block))} | more
    return gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}:{v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark):
    records = [foreign_record("warcinfo", "i", b"software: x"), foreign_record("response", "<urn:uuid:1>", b"one"), foreign_record("request", "q", b"GET"), foreign_record("resource", "<urn:uuid:2>", b"two \r\n\r\n two"), foreign_record("revisit", "<urn:uuid:3>", b"", **{"WARC-Payload-Digest": "sha1:ABC"}), foreign_record("response", "<urn:page:7>", b"x" * 3_000_000, **{"WARC-Payload-Digest": "sha256:zz"})]
    places, at = [], 0
    for r in records:
        places.append((at, len(r)))
        at += len(r)
    line = lambda k, n: f'com,x)/ 2020 {json.dumps({"url": "u", "filename": n, "offset": str(places[k][0]), "length": str(places[k][1])})}\n'
    index = "".join(line(k, "a.warc.gz") for k in (5, 1, 3, 4)) + line(0, "other.warc.gz")
    want = {("<urn:uuid:1>", None, 3, "response"), ("<urn:uuid:2>", None, 12, "resource"), ("<urn:uuid:3>", None, None, "revisit"), ("<urn:page:7>", 7, 3_000_000, "response")}
    kinds = {"indexed": (0, ("indexes/index.cdxj", index.encode())), "gzipped": (0, ("indexes/index.cdx.gz", gzip.compress(index.encode()[:100]) + gzip.compress(index.encode()[100:]))), "bare": (0, None), "deflated": (8, ("indexes/index.cdxj", index.encode()))}
    for kind, (method, second) in kinds.items():
        path = scratch_path(spark, f"warc-{kind}")
        os.makedirs(path.removeprefix("file:"))
        with zipfile.ZipFile(f"{path.removeprefix('file:')}/x.wacz", "w") as z:
            z.writestr("datapackage.json", "{}" * 99, zipfile.ZIP_DEFLATED)
            z.writestr("archive/a.warc.gz", b"".join(records), method)
            if second:
                z.writestr(*second, zipfile.ZIP_DEFLATED if kind == "deflated" else zipfile.ZIP_STORED)
        rows = warc.read_archives(spark, path).collect()
        assert {(r["record_id"], r["page_id"], r["payload_bytes"], r["record_type"]) for r in rows} == want, kind
        assert {r["payload_digest"] for r in rows if r["record_id"] == "<urn:uuid:1>"} == {base64.b32encode(hashlib.sha1(b"one").digest()).decode()}


def test_ranges_by_uri(spark, tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(bytes(range(200)))
    monkeypatch.setattr(warc, "_local", lambda path: None)
    size, read = warc._ranges(f"file://{tmp_path}/f", None)
    assert size == 200 and read(10, 3) == bytes((10, 11, 12)) and read(198, 9) == bytes((198, 199))
    read.close()
    assert warc._by_range(f"file://{tmp_path}") and not warc._by_range("nosuchstore://x/y") and not warc._by_range(f"file://{tmp_path}/none")


def test_tasks_of_the_grid_join_stay_bounded():
    assert ego_join.tile_tasks(3, 8) == 16 and ego_join.tile_tasks(500, 8) == 1000
    blocks = 10**6 // ego_join.BLOCK_ROWS
    runs = blocks >> ego_join.TILE_BITS
    assert ego_join.tile_tasks(runs * (runs + 1) // 2, 8) <= ego_join.MOST_TASKS and ego_join.tile_tasks(10**12, 8) == ego_join.MOST_TASKS


def test_lookup_repeats_only_hot_keys(spark):
    """A table all of whose keys are repeated is broadcast as if it had the size of its file, and fills the driver."""
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id < 3000 THEN 'hot' WHEN id < 3100 THEN NULL ELSE CAST(id AS STRING) END AS k")
    table = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("first"))
    n = table.count()
    left, right = common.salted_sides(rows, table, "k", F.col("id"), 32)
    assert right.count() == n + 31 and right.select("k", "_salt").distinct().count() == n + 31
    salts = {r["k"]: r["n"] for r in left.where("k = 'hot' OR k IS NULL").groupBy("k").agg(F.count_distinct("_salt").alias("n")).collect()}
    assert salts["hot"] == 32 and salts[None] > 16
    found = common.salted_lookup(rows, table, "k", F.col("id"))
    assert found.columns == ["k", "id", "first"]
    assert {r["id"]: r["first"] for r in found.collect()} == {i: 0 if i < 3000 else None if i < 3100 else i for i in range(6000)}


def test_all_block_pairs_come_once_and_nothing_is_shuffled(spark, tmp_path):
    rng = np.random.default_rng(9)
    boxes = [(int(b), 4 + int(b) % 2, low.tolist(), (low + rng.random(4)).tolist()) for b, low in zip(rng.choice(200, 40, replace=False), rng.normal(size=(40, 4)))]
    spark.createDataFrame(boxes, "block long, width int, low array<double>, high array<double>").repartition(5).write.parquet(f"{tmp_path}/boxes")
    pairs = ego_join.all_block_pairs(spark.read.parquet(f"{tmp_path}/boxes"), 3, 0.5)
    gap = lambda x, y: sum(max(a - d, c - b, 0) ** 2 for a, b, c, d in zip(x[2], x[3], y[2], y[3]))
    want = Counter((min(x[0], y[0]), max(x[0], y[0])) for k, x in enumerate(boxes) for y in boxes[k:] if x[1] == y[1] and gap(x, y) <= 0.25)
    assert Counter((min(r["x_block"], r["y_block"]), max(r["x_block"], r["y_block"])) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_both_ways_to_pair_blocks_agree(spark, monkeypatch):
    df, _ = vectors(spark)
    found = []
    for few in (0, 10**9):
        monkeypatch.setattr(ego_join, "FEW_TILES", few)
        found.append(sorted(map(tuple, ego_join.near_duplicates(df, block_rows=4).collect())))
    assert found[0] == found[1] and any(n for _, n, *_ in found[0])
    # of doubles that floats can't tell apart from the threshold
    a, b = 0.95 + 1e-9, 0.95 - 1e-9
    near = [(1, [1.0, 0.0, 0.0]), (2, [a, math.sqrt(1 - a * a), 0.0]), (3, [b, 0.0, math.sqrt(1 - b * b)])]
    got = ego_join.near_duplicates(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {1: 1, 2: 1, 3: 0}
