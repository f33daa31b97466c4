import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import DOCS, sentence
from .test_copies_and_archives import components_by_force
from .test_filters import shares_by_force


def folder(spark, tmp_path):
    rng = random.Random(21)
    items = [(k, sentence(rng, 30, 600)) for k in range(5)]
    rows, labels = [], []
    for i in range(600):
        words = sentence(rng, rng.randrange(30, 90), 600).split()
        if i % 7 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        labels.append((i, 1, int(i % 7 == 0)))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[1][1]) for i in range(30)]
    rows += [(2000 + i, rows[2][1] + " " + items[i][1]) for i in range(5)]
    rows += [(3000, None), (3001, "")]
    docs = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", len(t) if t is not None else None) for i, t in rows]
    for name, data, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    docs = folder(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    kept = {r["doc_id"] for r in rows}
    assert not kept & set(range(1000, 1030)) and not kept & set(range(2000, 2005)) and 1 in kept
    assert {3000, 3001} <= kept
    toxic = {i for i in range(0, 600, 7)}
    clean = {i for i, *_ in docs if i < 600} - toxic
    assert len(kept & toxic) <= 2 and len(clean - kept) <= 5
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    copies = Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 2
    assert set(corpus_pipeline.COLUMNS) < set(out.columns)
    texts = {i: t for i, t, *_ in docs}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept; toxicity by its own model, whose parts test_filters holds against brute force."""
    folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    repeated = docs.where("doc_id IN (1, 5)")
    docs = docs.unionByName(repeated).unionByName(repeated.withColumn("doc_id", F.lit(None).cast("long"))).withColumn("shard", F.lit("own"))
    stages, text = dict(corpus_pipeline.STAGES), lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    def after(name, df):
        path = f"{tmp_path}/{name}"
        stages[name](spark, df, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    clean = after("toxicity", docs)
    assert clean.columns == corpus_pipeline.COLUMNS and not text(clean) - text(docs)

    alone = after("ngram_jaccard", clean)
    rows = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] is not None}
    _, component = components_by_force(list(rows.items()))
    unnamed = Counter({k: n for k, n in text(clean).items() if k[0] is None})
    assert text(alone) == Counter((i, t) for i, t in rows.items() if component[i] == i) + unnamed

    fair = after("decontamination", alone)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    named = [(r["doc_id"], r["text"] or "") for r in alone.collect() if r["doc_id"] is not None]
    bad = {i for i, _ in shares_by_force(named, items, n_docs=alone.count())}
    assert bad and text(fair) == Counter({k: n for k, n in text(alone).items() if k[0] not in bad})

    mixed = after("mixing", fair)
    kept, tokens = text(fair), Counter()
    for r in fair.collect():
        tokens[r["source"]] += max(1, len((r["text"] or "").split()))
    spent = Counter()
    for r in mixed.collect():
        spent[r["source"]] += max(1, len((r["text"] or "").split()))
    shares = sorted(spent[s] / tokens[s] for s in tokens)
    assert set(text(mixed)) == set(kept) and all(n >= kept[k] for k, n in text(mixed).items()) and 1 <= shares[0] and shares[-1] <= 1.5

    dealt = after("sharding", mixed)
    assert text(dealt) == text(mixed)
    slots = {}
    for r in dealt.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(corpus_pipeline.N_SHARDS)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
