"""Quality rules: an isolation forest on rule statistics.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text, case kept. The base statistics of a text are counted
a batch at a time; from them and a few more come rates per word, letter or line, drawn toward the corpus
mean by SHRINK of these so that short texts aren't odd for their length alone. A rule is broken by what a
rate exceeds its limit, the USUAL quantile of the good labelled rows. The forest's trees split random
excesses at random values of a subsample; a document's anomaly score is 2^(-E(path)/c(subsample)). The
threshold is the score at which labelled rows separate best: the largest share of poor rows found less
GOOD_WEIGHT times the share of good rows lost, among the documents that pass the base rules.

Every row is a candidate for the subsamples: they are the TREES * SUBSAMPLE rows of least hash among
those that pass the base rules, dealt to trees by rank. Corpus means, limits (to one part in 10,000 of
the rows) and the threshold's counts are over all rows. Null and empty texts have zero words and fail the base rules; a null doc_id has no label;
repeated rows are each judged; several labels of one doc_id count as poor if one is 0; null labels are
left out; without labelled rows of both kinds nothing but the base rules rejects; an empty table gives
an empty result. Other columns are ignored. A text is processed whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, ship, staged
from ledgerloom.llm.shingles import SIZE, _BASE, chunks, mix, word_spans

ship(__name__)

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
TREES, SUBSAMPLE, SEED = 200, 64, 13
SHRINK = 20.0
GOOD_WEIGHT = 10.0
USUAL = 0.99
#: Scores are compared on this many steps between 0 and 1.
STEPS = 10_000
SYMBOLS = b"#*$%&|<>"
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.arange(256)
#: Which byte values count as: code points outside gaps, symbols, capitals, letters, marks.
_KINDS = np.stack(
    [
        ((_BYTES & 0xC0) != 0x80) & ~_GAPS,
        np.isin(_BYTES, list(SYMBOLS)),
        (_BYTES >= 65) & (_BYTES <= 90),
        ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128) | (_BYTES >= 0xC0),
        (_BYTES > 32) & (_BYTES < 127) & ~np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)]),
    ],
    axis=1,
).astype(np.int64)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks", "n_same_words"]
#: Rates whose excess the forest splits on: a count over another.
RATES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "capitals": ("n_capitals", "n_letters"),
    "repeats": ("n_repeat_words", "n_words"),
    "same": ("n_same_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether it lies in a window of SIZE words that its text holds twice or more, and whether it equals the word before."""
    n = len(starts)
    up = np.full(len(data) + 1, _BASE, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    sums = np.zeros(len(data) + 1, np.uint64)
    # powers run down to the end of each word by multiplying with what is left of the chunk
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1][::-1], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * up[ends - 1] + (ends - starts).astype(np.uint64))
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))
    as_before = np.zeros(n, bool)
    as_before[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    if n < SIZE:
        return np.zeros(n, bool), as_before
    windows = mix(text[: n - SIZE + 1].astype(np.uint64))
    for i in range(SIZE):
        windows = mix(windows * np.uint64(_BASE) + words[i : n - SIZE + 1 + i])
    within = np.flatnonzero(text[: n - SIZE + 1] == text[SIZE - 1 :])
    order = np.argsort(windows[within], kind="stable")
    run = windows[within][order]
    same = run[1:] == run[:-1]
    twice = np.zeros(len(run), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = within[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + SIZE, -1)
    return np.cumsum(cover)[:-1] > 0, as_before


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    held = [line for line in text.split(b"\n") if line.strip()]
    return len(held), len(held) - len(set(held))


def text_counts(column: pa.Array) -> np.ndarray:
    """COUNTS of each text of an Arrow column."""
    parts = []
    for data, offsets in chunks(column):
        out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
        if len(data):
            starts, ends = word_spans(data, offsets, _GAPS)
            places = np.searchsorted(starts, offsets)
            out[:, 0] = np.diff(places)
            for k, marked in zip((4, 9), _repeats(data, starts, ends, places)):
                upto = np.concatenate([[0], np.cumsum(marked)])
                out[:, k] = upto[places[1:]] - upto[places[:-1]]
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if b > a:
                    found = np.bincount(data[a:b], minlength=256) @ _KINDS
                    out[i, [1, 2, 6, 7, 8]] = found
                    out[i, 5], out[i, 3] = _lines(data[a:b].tobytes())
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def _count(keep: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_counts(batch.column("counted_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(found[:, k]) for k in range(len(COUNTS))]], [*keep, *COUNTS])

    return count


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the key and COUNTS of the whole text, and base_failed."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("counted_text"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.mapInArrow(_count([key]), schema)
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def excesses(counts: dict[str, np.ndarray], means: dict[str, float], limits: dict[str, float]) -> np.ndarray:
    """By how much each rate, drawn toward the corpus mean by SHRINK of its denominator, exceeds its limit."""
    return np.stack([np.maximum((counts[a] + SHRINK * means[r]) / (counts[b] + SHRINK) - limits[r], 0) for r, (a, b) in RATES.items()], axis=1)


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Nodes (feature, value, left, path): the right child follows the left; leaves have feature -1 and path their depth plus average_path of their rows."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes, waiting = [None], [(0, rows, 0)]
    while waiting:
        at, own, depth = waiting.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(own) < 2 or not len(open_features):
            nodes[at] = (-1, 0.0, 0, depth + float(average_path(len(own))))
            continue
        f = int(rng.choice(open_features))
        value = float(rng.uniform(low[f], high[f]))
        left = own[:, f] < value
        nodes[at] = (f, value, len(nodes), 0.0)
        waiting += [(len(nodes) + 1, own[~left], depth + 1), (len(nodes), own[left], depth + 1)]
        nodes += [None, None]
    return np.array(nodes, float)


def grow_forest(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> dict:
    """Trees over rows dealt by rank, or over random subsamples where there are too few, and the size of a subsample."""
    size = min(subsample, len(rows))
    made = []
    for k in range(trees):
        rng = np.random.default_rng([seed, k])
        own = rows[k::trees] if len(rows) >= trees * subsample else rows[np.sort(rng.choice(len(rows), size, replace=False))]
        made.append(grow_tree(own, rng))
    return {"trees": made, "size": size}


def anomaly_scores(forest: dict, rates: np.ndarray) -> np.ndarray:
    """2^(-mean path / c), in (0, 1], rounded to STEPS."""
    total = np.zeros(len(rates))
    rows = np.arange(len(rates))
    for nodes in forest["trees"]:
        feature, left = nodes[:, 0].astype(np.int64), nodes[:, 2].astype(np.int64)
        at = np.zeros(len(rates), np.int64)
        while True:
            f = feature[at]
            if (f < 0).all():
                break
            at = np.where(f < 0, at, left[at] + (rates[rows, np.maximum(f, 0)] >= nodes[at, 1]))
        total += nodes[at, 3]
    return np.round(2.0 ** (-total / len(forest["trees"]) / max(float(average_path(forest["size"])), 1e-9)) * STEPS) / STEPS


def _score(forest: dict, means: dict[str, float], limits: dict[str, float], keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: np.array(batch.column(c)).astype(float) for c in COUNTS}
            own = anomaly_scores(forest, excesses(counts, means, limits)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(own)], [*keep, "anomaly"])

    return score


def best_threshold(bins: list[tuple[float, int, int]]) -> float | None:
    """Of (score, good rows, poor rows) the score from which rejecting gains most; None if a kind is missing or nothing is gained. Ties go to the higher score."""
    bins = sorted(bins, reverse=True)
    goods, poors = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not goods or not poors:
        return None
    best, threshold, good, poor = 0.0, None, 0, 0
    for score, g, p in bins:
        good, poor = good + g, poor + p
        gain = poor / poors - GOOD_WEIGHT * good / goods
        if gain > best + 1e-12:
            best, threshold = gain, score
    return threshold


def judge_quality(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, COUNTS, base_failed, anomaly (double, 0 to 1) and kept.

    labels has the key and quality (0 poor, 1 good). kept is false where base_failed holds or the
    anomaly reaches the calibrated threshold. trees * subsample rows at most are collected to grow trees.
    """
    stats = staged(rule_statistics(docs, key, text), "quality-counts")
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
    totals = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
    means = {r: totals[a] / max(1, totals[b]) for r, (a, b) in RATES.items()}
    rate = {r: (F.col(a) + SHRINK * means[r]) / (F.col(b) + SHRINK) for r, (a, b) in RATES.items()}
    good = stats.where("NOT base_failed").join(known.where("quality <> 0"), key)
    usual = good.agg(*[F.percentile_approx(x, USUAL, 10_000).alias(r) for r, x in rate.items()]).first()
    limits = {r: means[r] if usual[r] is None else usual[r] for r in RATES}
    shuffled = F.xxhash64(F.lit(SEED), key, *COUNTS)
    taken = stats.where("NOT base_failed").orderBy(shuffled, *COUNTS).limit(trees * subsample).toArrow()
    if not taken.num_rows:
        return stats.select(key, *COUNTS, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    forest = grow_forest(excesses({c: taken[c].to_numpy().astype(float) for c in COUNTS}, means, limits), trees, subsample)
    schema = f"`{key}` {stats.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double"
    scored = stats.mapInArrow(_score(forest, means, limits, stats.columns), schema)
    bins = scored.where("NOT base_failed").join(known, key).groupBy("anomaly").agg(F.sum((F.col("quality") != 0).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("poor"))
    threshold = best_threshold([tuple(r) for r in bins.collect()])
    passed = F.lit(True) if threshold is None else F.col("anomaly") < threshold
    return scored.withColumn("kept", ~F.col("base_failed") & passed)
