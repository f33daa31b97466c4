"""Toxicity from class-conditional Kneser-Ney models.

Two models over UTF-8 bytes of lower-cased words, with marks for a word's start and end, are
counted on toxic and on ordinary documents. Each discounts its own counts of ORDER-byte sequences
and backs off to one interpolated Kneser-Ney model of both classes together: its highest order
uses the summed counts, lower ones the number of distinct bytes before a sequence, with absolute
discounts. So rare words back off to the same distribution and speak for neither class.

A text's value is the mean over its words of log P(word | toxic) - log P(word | ordinary), that is
the difference of length-normalised log-likelihoods, and the mean of its words' gains above
STRONG, which one strong word can move however long the text. A logistic curve turns them into a
score; it is fitted on values from models that had not seen the document (two halves).

Models are fitted on a bounded sample of labelled rows: at most max_toxic and max_ordinary
documents, taken by hash, whole texts. Scores read the text only. Null and empty texts have value
0 and so the score of that value; rows with a null doc_id are scored and never learnt from; null labels are left out; without both classes every score is 0;
repeated rows are each scored; an empty table gives an empty result.

Every gram counts, those met once too. What is broadcast is the deflated table of counts; each
worker builds its levels from that.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, ship, staged
from ledgerloom.llm.shingles import chunks, word_hashes

ship(__name__)

ORDER = 7
DISCOUNT = 0.75
STRONG = 1.5
MAX_TOXIC, MAX_ORDINARY = 4000, 8000
CACHE_WORDS = 2_000_000
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LETTER = np.arange(256, dtype=np.uint64)
_LETTER[65:91] += 32
_EDGE = np.uint64(1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ORDER bytes that end at each place of each word (start mark, bytes, end mark; zeros before), and the words' offsets in it."""
    sizes = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(offsets[-1]) - offsets[word]
    codes = np.zeros(offsets[-1], np.uint64)
    last = (ends - starts)[word]
    for back in range(ORDER):
        at = place - back
        letter = np.where(at == last, _EDGE, _LETTER[data[np.minimum(starts[word] + np.maximum(at, 0), len(data) - 1)]])
        letter = np.where(at == -1, _EDGE, letter)
        letter = np.where(at < -1, np.uint64(0), letter)
        codes |= letter << np.uint64(8 * back)
    return codes, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, half, gram, n), summed within a batch."""
    for batch in batches:
        keys = np.array(batch.column("toxic")).astype(np.int64) * 2 + np.array(batch.column("half")).astype(np.int64)
        done = 0
        for data, offsets in chunks(batch.column("text")):
            _, places, starts, ends = word_hashes(data, offsets, _GAPS)
            codes, ends_at = grams(data, starts, ends) if len(starts) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
            kind = np.repeat(np.repeat(keys[done : done + len(offsets) - 1], np.diff(places)), np.diff(ends_at))
            done += len(offsets) - 1
            for k in range(4):
                found, n = np.unique(codes[kind == k], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k // 2, np.int32)), pa.array(np.full(len(found), k % 2, np.int32)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["toxic", "half", "gram", "n"])


def _level(codes: np.ndarray, counts: np.ndarray) -> tuple:
    """Of one order: grams with their discounted share after their context, contexts with their backoff weight."""
    held = counts > 0
    codes, counts = codes[held], counts[held]
    context, at = np.unique(codes >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, counts)
    share, weight = (counts - DISCOUNT) / total[at], DISCOUNT * np.bincount(at) / total
    return codes, share.astype(np.float32), context, weight.astype(np.float32)


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Levels from order 1 up of sorted distinct ORDER-byte codes and their counts."""
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append(_level(codes, counts))
        codes, at = np.unique(codes & np.uint64((1 << (8 * (order - 1))) - 1), return_inverse=True)
        counts = np.bincount(at).astype(np.float64)
    return levels[::-1]


def _deflated(numbers: np.ndarray) -> bytes:
    """Non-negative integers below 2^64, byte plane after byte plane, deflated without loss."""
    return zlib.compress(np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _inflated(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed_table(codes: np.ndarray, counts: dict[tuple[int, int], np.ndarray]) -> dict:
    """Sorted distinct codes as steps, and their counts by (class, half): the one table that all models are made of."""
    return {"steps": _deflated(np.diff(codes, prepend=np.uint64(0))), "counts": {k: _deflated(n) for k, n in counts.items()}}


def build(table: dict, halves: tuple[int, ...]) -> dict:
    """The model of these halves' documents."""
    codes = np.cumsum(_inflated(table["steps"]), dtype=np.uint64)
    own = [sum(_inflated(table["counts"][k, h]).astype(np.float64) for h in halves) for k in (0, 1)]
    seen = own[0] + own[1] > 0
    return {"both": kneser_ney(codes[seen], (own[0] + own[1])[seen]), "ordinary": _level(codes, own[0]), "toxic": _level(codes, own[1])}


def _model(shared: dict, halves: tuple[int, ...]) -> dict:
    """The model of a broadcast table, built once in each worker."""
    if halves not in shared:
        shared[halves] = build(shared, halves)
    return shared[halves]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def gram_gains(model: dict, codes: np.ndarray) -> np.ndarray:
    """log P(last byte | the others, toxic) - log P(last byte | the others, ordinary) of each code."""
    p = np.full(len(codes), 1 / 256)
    for order, (keys, share, contexts, weight) in enumerate(model["both"], 1):
        own = codes & np.uint64((1 << (8 * order)) - 1)
        p = _find(keys, share, own, 0.0) + _find(contexts, weight, own >> np.uint64(8), 1.0) * p
    toxic, ordinary = (_find(keys, share, codes, 0.0) + _find(contexts, weight, codes >> np.uint64(8), 1.0) * p for keys, share, contexts, weight in (model["toxic"], model["ordinary"]))
    return np.log(np.maximum(toxic, 1e-12)) - np.log(np.maximum(ordinary, 1e-12))


def word_gains(model: dict, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word; words met before come from the model's cache."""
    kinds, first, at = np.unique(words, return_index=True, return_inverse=True)
    known, gains = model.get("known", np.zeros(0, np.uint64)), model.get("gains", np.zeros(0))
    out = _find(known, gains, kinds, np.nan)
    new = np.flatnonzero(np.isnan(out))
    if len(new):
        where = first[new]
        codes, offsets = grams(data, starts[where], ends[where])
        uniq, back = np.unique(codes, return_inverse=True)
        gain = gram_gains(model, uniq)[back]
        out[new] = np.add.reduceat(gain, offsets[:-1])
        if len(known) > CACHE_WORDS:
            known, gains = known[:0], gains[:0]
        order = np.argsort(merged := np.concatenate([known, kinds[new]]), kind="stable")
        model["known"], model["gains"] = merged[order], np.concatenate([gains, out[new]])[order]
    return out[at]


def text_values(model: dict, column: pa.Array) -> np.ndarray:
    """For each text the mean gain of its words and the mean of their gains above STRONG."""
    parts = []
    for data, offsets in chunks(column):
        words, places, starts, ends = word_hashes(data, offsets, _GAPS)
        gains = word_gains(model, data, words, starts, ends) if len(words) else np.zeros(0)
        n = np.maximum(np.diff(places), 1)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gains, np.maximum(gains - STRONG, 0))]
        parts.append(np.stack([(s[places[1:]] - s[places[:-1]]) / n for s in sums], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 2))


def _features(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(values), 1)), np.clip(values, -1, 1) * 10, np.log1p(np.maximum(values[:, 1:], 0) * 1000)], axis=1)


def fit_curve(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x, w = _features(values), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weights * (labels - p)) - 0.1 * w
        step = np.linalg.solve((x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(4), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _values(table):
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = np.array(batch.column("half"))
            out = np.zeros((batch.num_rows, 2))
            for k in (0, 1):
                rows = np.flatnonzero(half == k)
                if len(rows):
                    out[rows] = text_values(_model(table.value, (1 - k,)), batch.column("text").take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out[:, 0]), pa.array(out[:, 1])], ["toxic", "mean", "strong"])

    return values


def _score(table, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = text_values(_model(table.value, (0, 1)), batch.column("scored_text"))
            p = 1 / (1 + np.exp(-np.clip(_features(values) @ table.value["curve"], -30, 30)))
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(values[:, 0])], [*keep, "score", "predicted", "gain"])

    return score


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> dict | None:
    """Table and curve of the model from docs (doc_id, text) and labels (doc_id, toxic), or None without both classes."""
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = staged(known.withColumn("h", F.xxhash64(F.lit(5), "doc_id")), "toxicity-labels")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    taken = [known.where(F.col("toxic") == k).orderBy("h").limit(most) for k, most in ((1, max_toxic), (0, max_ordinary))]
    taken = staged(taken[0].union(taken[1]).select("doc_id", "toxic", F.pmod(F.shiftright("h", 7), F.lit(2)).cast("int").alias("half")), "toxicity-sample")
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), "toxicity-texts").repartition(2 * spark.sparkContext.defaultParallelism)
    counted = rows.select("toxic", "half", "text").mapInArrow(_count, "toxic int, half int, gram long, n long")
    table = counted.groupBy("gram").pivot("toxic", [0, 1]).agg(*[F.sum(F.when(F.col("half") == h, F.col("n"))).alias(f"h{h}") for h in (0, 1)])
    table = table.na.fill(0).toArrow()
    codes = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    packed = packed_table(codes[order], {(k, h): table[f"{k}_h{h}"].to_numpy()[order] for k in (0, 1) for h in (0, 1)})

    halves = spark.sparkContext.broadcast(packed)
    values = rows.select("toxic", "half", "text").mapInArrow(_values(halves), "toxic int, mean double, strong double").toArrow()
    halves.destroy()
    labels_seen = values["toxic"].to_numpy()
    x = np.stack([values["mean"].to_numpy(), values["strong"].to_numpy()], axis=1)
    weights = np.where(labels_seen == 1, totals[1] / max(1, (labels_seen == 1).sum()), totals[0] / max(1, (labels_seen == 0).sum()))
    return packed | {"curve": fit_curve(x, labels_seen, weights / weights.mean())}


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> DataFrame:
    """Per row of docs: the columns to keep (the key), score double, predicted int, gain double (mean difference of log-likelihoods).

    labels must hold training rows only. Columns of docs named like the new ones are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    made = ("score", "predicted", "gain")
    keep = [c for c in keep or [key] if c not in made]
    rows = docs.select(*keep, F.col(text).alias("scored_text"))
    model = fit(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels, max_toxic, max_ordinary)
    if model is None:
        return rows.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("gain"))
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "score double", "predicted int", "gain double"])
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), keep), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
