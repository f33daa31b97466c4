import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, mixing, sharding

LOG = "conv_id long, message long, seq long, op string, role string, text string"
SAID = "<|im_end|><|im_start|>assistant ok"


def rendered(spark, rows):
    return chat_format.render(chat_format.fold_events(spark.createDataFrame(rows, LOG)))


def turns(spark, rows):
    return {r["conv_id"]: [(t.role, t.text, t.loss) for t in r["turns"]] for r in chat_format.read_back(rendered(spark, rows)).collect()}


def test_deltas_edits_and_regenerations_fold(spark):
    rows = [
        (1, 0, 0, "delta", "user", "hi"),
        (1, 1, 2, "delta", "assistant", "lo"),
        (1, 1, 1, "delta", "assistant", "hel"),
        (1, 2, 3, "delta", "user", "gone"),
        (1, 1, 4, "regenerate", "assistant", "bet"),
        (1, 1, 5, None, "assistant", "ter"),
        (1, 2, 6, "delta", "user", "stays"),
        (1, 0, 7, "edit", "user", "hey"),
        (2, 0, 0, "delta", None, None),
    ]
    assert turns(spark, rows) == {1: [("user", "hey", False), ("assistant", "better", True), ("user", "stays", False)], 2: [("", "", False)]}


def test_control_strings_come_back(spark):
    texts = [SAID, "a<|b", "a<\\|b", "a<\\\\|b\\|", "\n<|im_end|>\n", "$1 \\1 %0A", "é<|", "", "x" * 50000]
    rows = [(0, i, 0, "delta", "ass%0A\nistant<|" if i == 0 else "assistant", t) for i, t in enumerate(texts)]
    got = turns(spark, rows)[0]
    assert [t for _, t, _ in got] == texts
    assert got[0][0] == "ass%0A\nistant<|" and not got[0][2] and got[1][2]


def test_digests_and_repeats(spark):
    rows = [(5, 1, "assistant", "b"), (5, 0, "user", SAID), (5, 1, "assistant", "b"), (6, 0, "assistant", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_digests(chat_format.render(chat_format.fold_events(chat_format.conversation_events(conv)))).collect()}
    log = chat_format.conversation_events(conv).collect()
    assert {r["op"] for r in log} == {"delta", "edit", "regenerate"} and len(log) == 6 * len(rows)
    seqs = sorted(r["seq"] for r in log if r["conv_id"] == 5)
    assert len(set(seqs)) == len(seqs)
    whole = f"user\n{SAID}\nassistant\nb\nassistant\nb\n"
    assert got[5]["n_turns"] == 3 and got[5]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[5]["loss_chars"] == 2 and got[5]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[6]["loss_chars"] == 0 and got[6]["n_turns"] == 1


def test_empty_log(spark):
    assert rendered(spark, []).count() == 0


def test_shards_are_even_gapless_and_mixed(spark):
    rows = spark.range(10007).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("x").alias("shard"), F.lit(1).alias("bucket"))
    got = sharding.interleave_shards(rows, 40).collect()
    assert len(got) == 10007 and {r["bucket"] for r in got} == {1}
    slots, mix = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mix[r["shard"]][r["source"]] += 1
    counts = [len(x) for x in slots.values()]
    assert set(slots) == set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    whole = Counter(r["source"] for r in got)
    assert all(abs(m[s] - n / 40) <= 1.5 for m in mix.values() for s, n in whole.items())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave_shards(rows.repartition(7), 40).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_shards_of_odd_tables(spark, docs, no_docs):
    assert sharding.interleave_shards(no_docs, 3).count() == 0
    twice = docs.union(docs)
    got = sharding.interleave_shards(twice, 7).collect()
    assert len(got) == 2 * docs.count()
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1
    sizes = {r["doc_id"]: (r["s"], r["c"]) for r in docs.select("doc_id", sharding.text_size(F.col("text")).alias("s"), sharding.text_crc32(F.col("text")).alias("c")).collect()}
    assert sizes[77] == (16, 0) and sizes[80] == (23, zlib.crc32(b"one two"))


def mixed_counts(mixed):
    return {(r["source"], r["epoch"]): (r["n"], r["t"]) for r in mixed.groupBy("source", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}


def test_mixing_meets_entropy_and_budget(spark):
    text = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int")), " ")
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), text.alias("text"), F.lit(0).alias("_h"))
    mixed = mixing.mix_sources(rows, target_entropy=0.9, max_repeats=10.0)
    weights = {r["source"]: (r["weight"], r["repeats"]) for r in mixed.select("source", "weight", "repeats").distinct().collect()}
    entropy = -sum(w * math.log(w) for w, _ in weights.values())
    assert abs(entropy - 0.9 * math.log(3)) < 1e-3
    assert abs(weights["big"][1] - 1) < 1e-6
    own = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    counts = mixed_counts(mixed)
    for s, (_, repeats) in weights.items():
        spent = sum(t for (x, _), (_, t) in counts.items() if x == s)
        assert -1e-3 <= repeats * own[s] - spent <= 10
        for e in range(math.floor(repeats + 1e-9)):
            assert counts[s, e][1] == own[s]
    assert "_h" in mixed.columns
    limited = mixing.mix_sources(rows, target_entropy=0.99, max_repeats=1.3)
    assert max(r["repeats"] for r in limited.select("repeats").distinct().collect()) <= 1.3 + 1e-4


def test_mixing_cut_is_a_prefix_of_the_permutation(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"), F.lit("x y").alias("text"))
    placed = mixing.block_slots(mixing.mix_sources(rows, target_entropy=0.95, max_repeats=3.0).select("doc_id", "source", "epoch"))
    slots = defaultdict(list)
    for r in placed.collect():
        slots[r["source"], r["epoch"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) >= 3


def test_mixing_keeps_every_document_and_odd_rows(spark, docs, no_docs):
    mixed = mixing.mix_sources(docs)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert mixing.mix_sources(no_docs).count() == 0
    few = mixing.mix_sources(docs, budget=500)
    assert few.agg(F.sum("n_tokens")).first()[0] <= 500


def test_regenerations_void_what_later_messages_held(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * t) for t in range(6)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.conversation_events(conv)
    want = [(r[2], r[3]) for r in rows]
    got = chat_format.fold_events(log).orderBy("message").collect()
    assert [(r["role"], r["text"]) for r in got] == want
    edits = log.where("op = 'regenerate'").withColumn("op", F.lit("edit"))
    kept = chat_format.fold_events(log.where("op <> 'regenerate'").unionByName(edits)).orderBy("message").collect()
    assert [r["text"] for r in kept if r["message"].turn in (0, 1, 3, 5)] == [r[3] for r in rows if r[1] in (0, 1, 3, 5)]
    assert all(k["text"] != r[3] for k, r in zip(kept, rows) if r[1] in (2, 4))


def test_many_sources_of_one_size_spread(spark):
    n = 30_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("p"), F.floor(F.col("id") / 6).cast("string"))).alias("source"))
    got = sharding.interleave_shards(rows, 7)
    plan = [(r["part"], r["h"], r["stratum"], r["doc_id"]) for r in _parts(rows).collect()]
    want = {d: i * 7 // n for i, (*_, d) in enumerate(sorted(plan))}
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == want
    heavy = sharding._tie_ranks(_parts(rows).withColumn("slice", F.floor(F.col("part") * 8)), 500, ["part", "h", "stratum"])
    assert [r["doc_id"] for r in heavy.orderBy("place").collect()] == [d for *_, d in sorted(plan)]
    assert heavy.groupBy("slice", "bucket").count().agg(F.max("count")).first()[0] < 1500


def _parts(rows):
    """Fractional ranks by plain windows."""
    from pyspark.sql import Window

    from ledgerloom.llm.common import portable_hash, stratum

    made = rows.select("doc_id", stratum("source").alias("stratum"), portable_hash(sharding.SEED, "doc_id").alias("h"))
    own = Window.partitionBy("stratum")
    return made.withColumn("part", (F.row_number().over(own.orderBy("h", "doc_id")) - F.lit(0.5)) / F.count(F.lit(1)).over(own))
