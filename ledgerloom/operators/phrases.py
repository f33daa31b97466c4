"""Recurring phrases of narrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.narration import STOP_WORDS, normalised, phrases


def phrase_frequency(vouchers: DataFrame, narration: str = "narration", least: int = 2, lengths: tuple[int, ...] = (1, 2, 3), search: str = "", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(phrase, words, n): vouchers that hold each phrase of the wanted lengths, at least `least` of them. A voucher counts a phrase once."""
    said = vouchers.select(F.explode(phrases(normalised(F.col(narration)), max(lengths), stop_words)).alias("phrase"))
    said = said.withColumn("words", F.size(F.split("phrase", " "))).where(F.col("words").isin(*lengths))
    if search:
        said = said.where(F.col("phrase").contains(search.lower()))
    return said.groupBy("phrase", "words").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ranked(frequency: DataFrame, most: int = 50) -> DataFrame:
    """The most frequent phrases in order, ties by phrase."""
    return frequency.orderBy(F.desc("n"), "phrase").limit(most)
