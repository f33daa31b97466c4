"""Columns beside those an operator reads, named like ones it makes, change nothing."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontaminate, mixing, sharding, toxicity, warc
from ledgerloom.llm.common import scratch_path

from .conftest import sentence


def more(df, *names):
    """df with these columns, all text."""
    return df.withColumns({n: F.lit("clash") for n in names})


def same(one, two):
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_chat_events(spark):
    conv = spark.createDataFrame([(1, t, r, f"text {t}") for t, r in enumerate(("user", "assistant", "user", "assistant"))], "conv_id long, turn long, role string, text string")
    log = chat_format.conversation_events(conv)
    same(log, chat_format.conversation_events(more(conv, "message", "seq", "op", "k", "void", "log")))
    told = chat_format.render(chat_format.fold_events(log))
    same(told, chat_format.render(more(chat_format.fold_events(more(log, "log", "reset", "regenerated", "voided")), "turns", "formatted", "loss_mask")))


def test_sharding_keeps_what_comes_along(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("source"))
    names = ("row", "stratum", "h", "k0", "bucket", "rank", "size", "part", "slice", "place", "cut", "heavy", "in_slice", "before")
    wide = sharding.interleave_shards(more(rows, *names, "shard", "slot"), 5)
    same(sharding.interleave_shards(rows, 5).select("doc_id", "source", "shard", "slot"), wide.select("doc_id", "source", "shard", "slot"))
    assert wide.where(" OR ".join(f"`{n}` <> 'clash'" for n in names)).count() == 0


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, None, None)], "page_id long, url string, html string")
    found = []
    for df in (pages, more(pages, "digest", "first", "n", "refers_to", "piece", "payload", "_salt")):
        path = scratch_path(spark, "warc-clash")
        warc.write_archives(df, path)
        found.append(warc.read_archives(spark, path).drop("path", "offset", "length"))
    same(*found)


def test_mixing_keeps_what_comes_along(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, "a").otherwise("b").alias("source"), F.lit("w x y").alias("text"))
    names = ("_stratum", "_h", "_b", "_n", "_k0", "_tokens", "_passes", "_rest", "_cut", "_last", "_copies", "row")
    wide = mixing.mix_sources(more(docs, *names, "epoch", "weight", "repeats", "n_tokens"))
    columns = ["doc_id", "source", "n_tokens", "weight", "repeats", "epoch"]
    same(mixing.mix_sources(docs).select(*columns), wide.select(*columns))
    assert wide.where(" OR ".join(f"`{n}` <> 'clash'" for n in names)).count() == 0


def test_decontamination_and_toxicity(spark):
    import random

    rng = random.Random(3)
    items = [(k, sentence(rng, 20, 3000)) for k in range(5)]
    docs = spark.createDataFrame([(i, sentence(rng, 30, 3000) + " " + items[i % 5][1]) for i in range(10)] + [(i, sentence(rng, 30, 3000)) for i in range(10, 20)] + [(None, "x")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = more(docs, "words", "shingle", "place", "length", "windows", "item_id", "start", "n", "weight", "whole", "shingles", "block", "value")
    same(decontaminate.contamination(docs, bench), decontaminate.contamination(clash, more(bench, "words", "length", "shingles", "at", "weight", "before", "items", "theirs")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels)
    same(scored, toxicity.score_toxicity(more(docs, "toxic", "half", "h", "scored_text", "score", "predicted", "gain"), labels))
    assert scored.where("doc_id IS NULL").count() == 1 and scored.where("score IS NULL").count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_rows_with_clashes(spark, n):
    docs = more(spark.createDataFrame([(1, "a b", "s")][:n], "doc_id long, text string, source string"), "h", "rank", "_h")
    assert sharding.interleave_shards(docs, 3).count() == n and mixing.mix_sources(docs).count() == n
