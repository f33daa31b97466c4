import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, licenses, line_templates, toxicity

from .conftest import sentence

WORD = re.compile(licenses.WORD)


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan_licenses(df).collect(), key=lambda r: r["doc_id"])]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lowered(text))
    hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def brute_met(text):
    words = WORD.findall(lowered(text))
    met = {}
    for label, length, tokens in licenses.template_sets(licenses.TEMPLATES):
        for k in range(0, max(1, -(-len(words) // length))):
            share = len(tokens & set(words[k * length : (k + 2) * length])) / len(tokens)
            if share >= licenses.THRESHOLD - 1e-9:
                met[label] = max(met.get(label, 0), share)
    return met


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(3)
    notices = [n for t in licenses.TEMPLATES.values() for n in t] + list(licenses.BASE_PHRASES)
    texts = [None, "", "...", "Under the MIT License!under-the mit\nlicense", "sunder the mit license", "cc byé nc", "CC BY-NC", "Apache License, Version 2.0", "all RIGHTS (reserved)", "this wor\u212a is licensed under the GNU General Public License version 3", "CC by nc \u00c9 ALL RIGHTS RESERVED", "x " * 30000 + "under the mit license"]
    for _ in range(40):
        words = sentence(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            notice = rng.choice(notices).split()
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "other"
            words[at:at] = notice
        texts.append(rng.choice([" ", "-", ".\n"]).join(words))
    for text, r in zip(texts, scan(spark, texts)):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text), text
        met = brute_met(text)
        base = {x for x in r["base_labels"].split(",") if x}
        assert r["labels"] == ",".join(sorted(base | set(met))), text
        assert r["score"] == pytest.approx(1.0 if base else max(met.values(), default=0.0))


def test_license_scan_of_odd_tables(spark):
    assert scan(spark, []) == []
    notice = "Released under the MIT license."
    rows = [(1, notice, "x", "own", 1), (1, notice, "x", "own", 1), (None, "all rights reserved", "y", "own", 2), (None, "nothing", None, "own", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low string, labels string, t1 int")
    got = licenses.scan_licenses(df, keep=("doc_id", "low", "labels", "t1", "text")).collect()
    assert sorted((r["t1"], r["low"] or "", r["labels"], r["text"]) for r in got) == [(1, "x", "mit", notice)] * 2 + [(2, "y", "all-rights-reserved", "all rights reserved"), (3, "", "", "nothing")]
    few = licenses.scan_licenses(df, templates={"mine": ("nothing",)}, phrases={"rights reserved": "base"}).collect()
    assert sorted(r["labels"] for r in few) == ["", "", "base", "mine"]
    lapped = licenses.scan_licenses(spark.createDataFrame([(1, "A b-a b a, ab a b a"), (2, "a b")], "doc_id long, text string"), templates={"mine": ("nothing",)}, phrases={"a b a": "lap"}).collect()
    assert {(r["doc_id"], r["n_base"], r["first_word"], r["last_word"]) for r in lapped} == {(1, 3, 0, 6), (2, 0, None, None)}


def leaks_by_force(docs, items):
    words = lambda t: WORD.findall((t or "").lower())
    out = set()
    for i, t in docs:
        own = words(t if i is not None else None)
        have = " " + " ".join(own) + " "
        for k, x in items:
            if words(x) and " " + " ".join(words(x)) + " " in have:
                out.add((i, k))
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(k, sentence(rng, rng.randrange(15, 60), 3000)) for k in range(30)] + [(30, "too short here"), (31, None), (32, ""), (33, "brief")]
    docs = []
    for i in range(120):
        words = sentence(rng, rng.randrange(0, 200), 3000).split()
        if i % 4 == 0:
            item = items[i % 30][1].upper().split()
            if i % 8 == 0:
                item[len(item) // 2] += ","
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((i, " ".join(words)))
    long = items[3][1].split()
    assert len(long) >= 15
    edited = next(x.split() for _, x in items if x and len(x.split()) > 45)
    edited[5] = "changed"
    docs += [(200, None), (201, ""), (202, " ".join(edited)), (203, " ".join(["the"] * 3000)), (204, items[1][1]), (204, items[1][1]), (205, "too short here"), (206, "Too short, here"), (207, "too short"), (208, "how brief"), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    force = leaks_by_force(docs, items)
    assert force <= leaks and {d for d, _ in leaks - force} == {202}
    rows = decontaminate.contamination(df, bench).collect()
    assert len(rows) == len(docs) and {r["doc_id"] for r in rows if r["contaminated"]} == {d for d, _ in leaks}
    assert all(len(r["item_ids"]) == r["n_items"] for r in rows)
    assert not any(r["contaminated"] for r in decontaminate.contamination(df, bench.limit(0)).collect())
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def shares_by_force(docs, items, n_docs=None):
    """The best share over all windows of every document and item that reaches 0.8. n_docs: rows, if more than docs."""
    shingles = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    words = {i: WORD.findall(t.lower()) for i, t in docs}
    times = Counter(s for ws in words.values() for s in shingles(ws))
    out = {}
    for k, x in items:
        theirs = WORD.findall(x.lower())
        weights = {s: math.log(1 + (n_docs or len(docs)) / (1 + times[s])) for s in shingles(theirs)}
        for i, ws in words.items():
            held = (set(shingles(ws[p : p + len(theirs)])) for p in range(max(1, len(ws) - len(theirs) + 1)))
            best = max(sum(w for s, w in weights.items() if s in h) for h in held) / sum(weights.values())
            if best >= 0.8 - 1e-9:
                out[i, k] = best
    return out


def test_decontamination_equals_brute_force_on_cut_items(spark):
    rng = random.Random(17)
    light = sentence(rng, 12, 3000).split()  # a run that many documents hold weighs little
    items = [(k, sentence(rng, rng.randrange(15, 60), 3000)) for k in range(36)]
    items += [(k, " ".join(light + sentence(rng, 12, 3000).split())) for k in range(36, 40)]
    docs = [(i, " ".join(sentence(rng, 20, 3000).split() + light)) for i in range(120)]
    for k, x in items:
        for kind in range(5):
            item = x.split()
            n = rng.randrange(1, max(2, len(item) // 5 + 2))
            other = sentence(rng, n, 3000).split()
            if kind == 0:
                item[:n] = other
            elif kind == 1:
                item[-n:] = other
            elif kind == 2:
                del item[:n]
            elif kind == 3:
                item[len(item) // 2 : len(item) // 2] = other[:2]
            else:
                item[:12] = sentence(rng, 12, 3000).split()
            docs.append((1000 + 10 * k + kind, " ".join([*sentence(rng, rng.randrange(40), 3000).split(), *item, *sentence(rng, rng.randrange(40), 3000).split()])))
    force = shares_by_force(docs, items)
    assert sum(0.8 <= x < 0.95 for x in force.values()) > 60
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    best = {(r["doc_id"], r["item_id"]): r["best"] for r in found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("best")).collect()}
    assert best.keys() == force.keys(), sorted(force.keys() ^ best.keys())
    assert all(best[k] == pytest.approx(force[k]) for k in force)


def test_simhash_blocks_hold_all_within_radius():
    assert decontaminate.RADIUS // decontaminate.BLOCKS == 1 and decontaminate.BLOCKS * 8 == decontaminate.BITS


def lines_by_force(docs, keep_first=False, min_docs=3):
    """Places of the lines dropped, from sets of documents."""
    rows = []
    for i, t in docs:
        for n, line in enumerate(t.split("\n") if t is not None and i is not None else []):
            line = line.strip(" \t\r\x0b\x0c")
            if line:
                rows.append((i, n, " ".join("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))))
    holders, kinds, support = {}, {}, {}
    for i, _, m in rows:
        leaf = (len(m.split(" ")), tuple(m.split(" ")[:3]))
        holders.setdefault(m, set()).add(i)
        kinds.setdefault(leaf, set()).add(m)
        for p, t in enumerate(m.split(" ")):
            if p >= 3 and t != "<*>":
                support.setdefault((leaf, p, t), set()).add(i)
    template = {m: m for m in holders}
    for leaf, own in kinds.items():
        for m in own if leaf[0] > 3 and len(own) > 1 else ():
            tokens = m.split(" ")
            const = [p >= 3 and len(support.get((leaf, p, t), ())) >= min_docs for p, t in enumerate(tokens)]
            if sum(const) and sum(const) >= 0.6 * (len(tokens) - 3):
                template[m] = " ".join(t if p < 3 or const[p] else "<*>" for p, t in enumerate(tokens))
    said = {}
    for m, own in holders.items():
        said.setdefault(template[m], set()).update(own)
    places = {}
    for i, n, m in rows:
        if len(said[template[m]]) >= min_docs:
            places.setdefault(template[m], set()).add((i, n))
    return {x for own in places.values() for x in own if not keep_first or x != min(own)}


def dropped_places(spark, docs, **more):
    """Places of the lines that are missing from each text that dedup_lines returns, by its n_dropped and the rest of the text."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = lines_by_force(docs, **more)
    out = line_templates.dedup_lines(df, **more).collect()
    assert len(out) == len(docs)
    for r, (i, t) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(docs, key=lambda x: (x[0] is None, x[0]))):
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        assert r["text"] == left, i
        assert r["n_dropped"] == sum(j == i for j, _ in want) and r["n_lines"] == (0 if t is None else len(t.split("\n")))
    return want


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_templates(spark, keep_first):
    rng = random.Random(11)
    docs = []
    for i in range(60):
        lines = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(4))]
        lines += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(2)]
        if i % 3 == 0:
            lines.append("Subscribe to our weekly letter")
        if i % 4 == 0:
            lines.insert(0, f"Posted by user {i} on day {i * 7} of the year")
        if i % 5 == 0:
            lines.append(f"Contact our team member {rng.choice(['Ann', 'Bob', 'Cyd'])}xyz{'abcdefgh'[i % 8]} for  all further\tdetails please")
        docs.append((i, "\n".join(lines)))
    letter = "Subscribe to our weekly letter"
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, f"{letter}\n" * 50), (104, "word " * 40000 + "\n" + letter), (105, "line\n" * 3000), (None, letter), (None, None)]
    dropped = dropped_places(spark, docs, keep_first=keep_first)
    assert len([x for x in dropped if x[0] == 103]) == 50 and ((0, docs[0][1].split("\n").index(letter)) in dropped) != keep_first
    assert line_templates.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_templates_on_random_words(spark):
    for seed in range(2):
        rng = random.Random(seed)
        docs = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c", "d1", "e"]) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(8)))) for i in range(40)]
        for min_docs in (1, 3, 4, 7):
            assert dropped_places(spark, docs, min_docs=min_docs) or min_docs > 3


def test_line_templates_count_a_document_once(spark):
    table = lambda names: "\n".join(f"the user called hello from {n} today please" for n in names)
    spread = lambda n: f"our staff were happy to meet {n} again here"
    both = lambda n: f"all shops will open again on {n} next week"
    docs = [(1, table(["Ann", "Bob", "Cyd", "Dee"])), (2, spread("Ann")), (3, spread("Bob")), (4, spread("Cyd")), (5, both("Monday") + "\n" + both("Friday")), (6, both("Sunday")), (6, both("Sunday")), (7, letter := "a line of its own\n" * 5), (7, letter)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r["n_dropped"] for r in line_templates.dedup_lines(df).collect()}
    assert rows == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}
    with pytest.raises(ValueError):
        line_templates.dedup_lines(df, min_docs=0)


def toxic_corpus():
    rng = random.Random(2)
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(900):
        words = sentence(rng, rng.randrange(20, 80), 300).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_holds_out(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(df, toxicity.training_labels(known)).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert [r["predicted"] for r in out if r["doc_id"] >= 1000] == [0, 0, 0]


def test_toxicity_keeps_grams_met_once():
    assert toxicity._level(np.array([5, 9], np.uint64), np.array([1.0, 3.0]))[0].tolist() == [5, 9]

    def codes_of(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return toxicity.grams(data, np.array([0]), np.array([len(data)]))[0]

    once, often = codes_of("zqxwvkjz"), codes_of("letters")
    codes = np.unique(np.concatenate([once, often]))
    counts = {(k, h): np.where(np.isin(codes, often), 50, 0) for k in (0, 1) for h in (0, 1)}
    counts[1, 0] = counts[1, 0] + np.isin(codes, once)  # a toxic word met once
    model = toxicity.build(toxicity.packed_table(codes, counts), (0, 1))
    assert model["toxic"][0].tolist() == codes.tolist()
    assert toxicity.gram_gains(model, once).sum() > 1 > abs(toxicity.gram_gains(model, often).sum())


def kneser_ney_by_force(words):
    """P(next byte | up to six before it, class) from dictionaries. words: (word, class)."""
    order, discount = toxicity.ORDER, toxicity.DISCOUNT
    pad = lambda w: (0,) * (order - 2) + (1,) + tuple(w.encode()) + (1,)
    counts = {k: Counter(x[i - order + 1 : i + 1] for w, c in words if c == k for x in [pad(w)] for i in range(order - 1, len(x))) for k in (0, 1)}
    levels, now = [], counts[0] + counts[1]
    for n in range(order, 0, -1):
        levels.append(now)
        now = Counter(g[1:] for g in now)

    def interpolated(table, gram, lower):
        own = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        return (max(own.get(gram, 0) - discount, 0) + discount * len(own) * lower) / sum(own.values())

    def shared(gram, n=order):
        return interpolated(levels[order - n], gram, shared(gram[1:], n - 1) if n > 1 else 1 / 256)

    return pad, lambda gram, k: interpolated(counts[k], gram, shared(gram))


def test_toxicity_model_equals_brute_force():
    rng = random.Random(13)
    some = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 10))) for _ in range(25)]
    words = [(rng.choice(some), rng.randrange(2)) for _ in range(120)] + [("rare", 1), ("plain", 0)]
    pad, p = kneser_ney_by_force(words)
    code = lambda w: toxicity.grams(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]
    found = [np.concatenate([code(w) for w, c in words if c == k]) for k in (0, 1)]
    codes = np.unique(np.concatenate(found))
    counts = {(k, h): np.array([(found[k] == c).sum() for c in codes]) if h == 0 else np.zeros(len(codes)) for k in (0, 1) for h in (0, 1)}
    model = toxicity.build(toxicity.packed_table(codes, counts), (0, 1))
    for w in [*some, "rare", "plain", "plainly", "abba", "zz", "é"]:
        x = pad(w)
        want = sum(math.log(p(g, 1)) - math.log(p(g, 0)) for i in range(toxicity.ORDER - 1, len(x)) for g in [x[i - toxicity.ORDER + 1 : i + 1]])
        assert toxicity.gram_gains(model, code(w)).sum() == pytest.approx(want, abs=1e-4), w


def test_toxicity_of_long_and_odd_texts(spark):
    rows, labels = toxic_corpus()
    odd = [(9000, "word " * 60000), (9001, "x" * 300000), (9002, None), (9003, ""), (None, "idiot moron"), (9004, rows[0][1]), (9004, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in [*rows, *odd]], "doc_id long, text string, score double")
    out = toxicity.score_toxicity(df, spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").select("doc_id", "toxic"), keep=["doc_id", "score", "text"]).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    scores = {}
    for r in out:
        scores.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(x) == 1 for x in scores.values())


def test_toxicity_without_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(df, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
