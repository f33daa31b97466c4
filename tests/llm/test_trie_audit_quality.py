import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, prefix_trie, quality_forest
from .conftest import make_docs, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"
LABELS = "doc_id long, quality int, toxic int"


# operator 11


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows, **how):
    frame = spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("clash")).withColumn("depth", F.lit(-1)).withColumn("weight", F.lit("x"))
    got = [tuple(r) for r in prefix_trie.prefix_rollup(frame, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def chats(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in list(range(0, 12)) + list(range(100, 140)) + [250, 399, 12345]:
        turns = [("user" if t % 2 == 0 else "assistant", rng.choice(["a", "b", "hallo", "ß😀"])) for t in range(rng.randrange(1, 9))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    for c in range(140, 170):  # one common conversation
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same answer")]
    rows += [(500, t, "user", f"long {t}") for t in range(300)] + [(501, t, "user", f"long {t}") for t in range(300)]
    rows += [(7, None, None, None), (8, 0, "user", "a"), (8, 0, "user", "a"), (None, 0, "user", "x"), (9, 3, "user", "y" * 5000)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = chats()
    assert trie_of(spark, rows, component=40, chunk=10) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_turn(spark):
    assert trie_of(spark, []) == set()
    one = [(3, 0, None, None)]
    assert trie_of(spark, one) == brute_trie(one)
    assert trie_of(spark, [(None, 0, "user", "x")]) == set()


def test_local_rollup_is_right_on_chains_stars_and_random_trees():
    rng = np.random.default_rng(1)
    for n, shape in itertools.product((1, 2, 7, 60), ("chain", "star", "random")):
        parent = np.array([-1] + [{"chain": i - 1, "star": 0, "random": int(rng.integers(0, i))}[shape] for i in range(1, n)])
        depth = np.zeros(n, np.int64)
        weight = rng.integers(1, 9, n)
        values = rng.integers(0, 100, (n, 2))
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        want = values.copy()
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            want[parent[i]] += want[i]
        shuffle = rng.permutation(n)
        place = np.argsort(shuffle)
        moved = np.where(parent[shuffle] < 0, -1, place[parent[shuffle]])
        assert (prefix_trie.local_rollup(moved, depth[shuffle], weight[shuffle], values[shuffle]) == want[shuffle]).all()


# operator 12


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least.get(t, i))
        fails.append((i, part or "", set(f)))
    out = {}
    for order in itertools.permutations("ABCDE"):
        left = fails
        for k, f in enumerate(order):
            gone = [x for x in left if f in x[2]]
            before = [x for x in fails if f in x[2] and x[2] & set(order[:k])]
            left = [x for x in left if f not in x[2]]
            for p in {x[1] for x in fails}:
                n = lambda xs: sum(x[1] == p for x in xs)
                out[p, "".join(order), k + 1] = [n(left), n(gone), n(before), sum(x[1] == p and x[2] == {f} for x in fails), n([x for x in gone if x[0] in good]), n([x for x in gone if x[0] in toxic])]
    share = Counter()
    for (p, order, k), v in out.items():
        share[p, order[k - 1]] += v[1]
    return {(*key, *v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    rng = random.Random(5)
    rows = [(i, t, lang) for i, t, lang, *_ in make_docs()]
    stem = sentence(rng, 260)
    rows += [(200 + i, stem, "de") for i in range(40)]  # one hot text
    rows += [(300 + i, f"{stem} {i % 7} tail #", None) for i in range(40)]  # one hot passage
    rows += [(400, "A B C " * 90, "fr"), (401, "a 100% | b", "fr"), (None, stem, "de"), (None, stem, ""), (402, "A B C " * 90, ""), (402, "A B C " * 90, "fr"), (403, "é" * 20, "fr"), (404, "é" * 20, "fr")]
    return rows


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 420)] + [(201, 0, None), (None, 1, 1), (202, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("weight", F.lit(0)).withColumn("mask", F.lit("x"))
    for target in (filter_audit.TARGET, 2000):
        got = {tuple(r) for r in filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS), target=target).collect()}
        assert got == brute_audit(rows, labels)


def test_a_row_is_looked_up_once_however_deep_its_prefixes(spark):
    rows = [(i, "same opening " * 200 + str(i // 5), "en") for i in range(60)] + [(60 + i, f"other {i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    held = docs.withColumn("weight", F.octet_length("text").cast("long"))
    assert len(filter_audit.heavy_prefixes(held, 4000)) >= 5
    plan = filter_audit.dealt_texts(docs, target=4000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    got = {r["doc_id"]: r["mask"] >> 4 for r in filter_audit.text_masks(docs, part="part", target=4000).collect()}
    assert got == {i: int(i < 60 and i % 5 > 0) for i in range(120)}


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit_filters(docs, spark.createDataFrame([], LABELS)).count() == 0


def test_prefixes_adapt_and_copies_are_salted(spark):
    rows = [(i, t or "", lang or "") for i, t, lang in audit_rows()]
    dealt = filter_audit.dealt_texts(spark.createDataFrame(rows, "doc_id long, text string, part string"), target=4000)
    parts = dealt.withColumn("task", F.spark_partition_id()).groupBy("task", "hot").agg(F.count("*").alias("n")).collect()
    assert len({r["task"] for r in parts if r["hot"]}) > 1
    whole = dealt.withColumn("task", F.spark_partition_id()).where("hot IS NULL").groupBy("body").agg(F.count_distinct("task").alias("n"))
    assert whole.where("n > 1").count() == 0


def test_trie_keeps_texts_that_open_each_other():
    trie = filter_audit.TextTrie(len)
    texts = [b"abc", b"abcdef", b"", b"abd", b"abc", b"ab", b"abcdeg", b"zz"]
    nodes = [trie.insert(t, 10 - k) for k, t in enumerate(texts)]
    assert [trie.values[n] for n in nodes] == [len(t) for t in texts]
    assert nodes[0] == nodes[4] and trie.least[nodes[0]] == 6 and len(set(nodes)) == 7


# operator 13


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), len(re.findall("[A-Z]", text)), sum(c.isascii() and c.isalpha() or ord(c) >= 0x80 for c in text), sum(32 < ord(c) < 127 and not c.isalnum() for c in text), sum(a == b for a, b in zip(w, w[1:]))]


ODD = [None, "", " \n\t\x0b ", "a", "a b c d e a b c d e", "x " * 50, "é\xa0b c \x85 d", "one\ntwo\none\n\n \none ", "One one ONE", "A#*$%&|<> b\r\nA#", "a\nb\na\n" * 40, "ab ab ab cd", "w " * 4 + "\n" + "w " * 4, "😀 😀 ß Ü", "q" * 70000]


def test_counts_equal_brute_force():
    texts = ODD + [t for _, t, *_ in make_docs()]
    for column in (pa.array(texts), pa.array(texts[::-1])[3:]):
        assert quality_forest.text_counts(column).tolist() == [brute_counts(t) for t in column.to_pylist()]


def path_length(nodes, row, at=0):
    f, value, left, path = nodes[at]
    return path if f < 0 else path_length(nodes, row, int(left) + (row[int(f)] >= value))


def test_scores_equal_paths_walked_one_by_one():
    rng = np.random.default_rng(2)
    rows = rng.random((500, 3))
    for n in (1, 2, 40, 500):
        forest = quality_forest.grow_forest(rows[:n], trees=20, subsample=16)
        c = max(float(quality_forest.average_path(forest["size"])), 1e-9)
        want = [round(2 ** (-np.mean([path_length(t, r) for t in forest["trees"]]) / c), 4) for r in rows]
        assert np.abs(quality_forest.anomaly_scores(forest, rows) - want).max() <= 1e-4


def test_threshold_is_the_best_of_all():
    rng = random.Random(4)
    bins = [(k / 20, rng.randrange(200 if k < 12 else 2), rng.randrange(20)) for k in range(21)]
    goods, poors = sum(b[1] for b in bins), sum(b[2] for b in bins)
    gain = lambda t: sum(b[2] for b in bins if b[0] >= t) / poors - quality_forest.GOOD_WEIGHT * sum(b[1] for b in bins if b[0] >= t) / goods
    assert gain(quality_forest.best_threshold(bins)) >= max(gain(b[0]) for b in bins) - 1e-9
    assert quality_forest.best_threshold([(0.5, 3, 0)]) is None and quality_forest.best_threshold([]) is None


def quality_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        text = " ".join(f"{sentence(rng, 12, 4000)}." for _ in range(rng.randrange(1, 12)))
        poor = i % 9 == 0
        if poor:
            text = [text.upper(), re.sub(" ", "%%% ", text), re.sub(" ", " | ", text)][i // 9 % 3]
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not poor), 0))
    return rows, labels


def test_poor_documents_go_and_good_ones_stay(spark):
    rows, labels = quality_rows()
    odd = [(None, "nothing to see here but a null id and some words more"), (1000, None), (1001, ""), (1001, "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(0)).withColumn("anomaly", F.lit(0))
    got = quality_forest.judge_quality(docs, spark.createDataFrame(labels + [(None, 0, 0), (3, None, 0)], LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r["doc_id"]: r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900}
    unseen = [i for i in range(900) if i % 2]
    assert sum(kept[i] for i in unseen if i % 9) >= 0.99 * sum(1 for i in unseen if i % 9)
    assert sum(not kept[i] for i in unseen if i % 9 == 0) >= 0.9 * sum(1 for i in unseen if i % 9 == 0)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] in texts:
            assert [r[c] for c in quality_forest.COUNTS] == brute_counts(texts[r["doc_id"]])
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in got if r["doc_id"] == 1000] == [(0, True, False)]


def test_without_labels_only_base_rules_reject(spark):
    rows, _ = quality_rows()
    docs = spark.createDataFrame(rows[:60], "doc_id long, text string")
    got = quality_forest.judge_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r["kept"] != r["base_failed"] for r in got) and len(got) == 60
    assert quality_forest.judge_quality(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
