"""Narrations and names: normal form, phrases, similarity, search, transliteration helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own words that say nothing about a payment.
STOP_WORDS = ("the", "of", "and", "to", "in", "for", "by", "from", "with", "on", "at", "is", "was", "this", "that", "ref", "no", "txn", "via")

#: Letters of scholarly romanisation and their plain forms, in both cases.
ROMAN_FROM = "āīūēōṛḷṃṁḥṅñṇṭḍśṣĀĪŪĒŌṚḶṂṀḤṄÑṆṬḌŚṢ"
ROMAN_TO = "aiueorlmmhnnntdssAIUEORLMMHNNNTDSS"

#: Forms of address, taken off the front of a name.
HONORIFICS = ("sri", "shri", "smt", "srimati", "mr", "mrs", "ms", "dr", "kum")


def normalised(c: Column) -> Column:
    """Lower case, single spaces for whatever is no letter, mark or digit of any script."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\pL\pM\pN]+", " "))


def is_word(w: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Longer than one character, no stop word, and digits only if ten of them (a phone number)."""
    return (F.length(w) > 1) & ~w.isin(*stop_words) & (~w.rlike("^[0-9]+$") | (F.length(w) == 10))


def phrases(normal: Column, longest: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct runs of one to `longest` neighbouring words, none of which is left out by is_word.

    Words left out become null, and a run with a null is null; words and runs are bound once, by
    the one-element arrays around them, so that each text is split and judged once.
    """
    words = F.transform(F.split(normal, " "), lambda w: F.when(is_word(w, stop_words), w))

    def runs_of(words: Column, n: int) -> Column:
        after = lambda i: [x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))]
        return F.transform(words, lambda w, i: F.concat(w, *after(i)))

    def runs(words: Column) -> Column:
        return F.array_distinct(F.array_compact(F.concat(*[runs_of(words, n) for n in range(1, longest + 1)])))

    return F.get(F.transform(F.array(words), runs), 0)


def tokens(c: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(F.split(normalised(c), " "), lambda w: F.length(w) > 2))


def similarity(a: Column, b: Column) -> Column:
    """Common words over the larger word set; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def alike(a: Column, b: Column, least: float = 0.3) -> Column:
    """Similar words, or one text inside the other (case aside); empty texts are like nothing."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return (x != "") & (y != "") & ((similarity(a, b) >= least) | x.contains(y) | y.contains(x))


def search_pattern(query: str) -> str:
    """Regular expression of a search: its words in order, any white space between, case aside."""
    return "(?i)" + r"\s+".join(re.escape(w) for w in query.split())


def plain_letters(c: Column) -> Column:
    """Romanised letters without their marks."""
    return F.regexp_replace(F.translate(c, ROMAN_FROM, ROMAN_TO), r"\p{M}", "")


def odd_name(c: Column) -> Column:
    """Names to look at: letters outside ASCII, or a word of more than 15 characters."""
    return c.rlike(r"[^\x00-\x7F]") | F.exists(F.split(c, r"\s+"), lambda w: F.length(w) > 15)


def clean_name(c: Column) -> Column:
    """Forms of address off the front, dashes as spaces, plain letters, capital initials."""
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "[-–—]", " "), r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)^((" + "|".join(HONORIFICS) + r")\.?\s+)+", "")
    return F.initcap(plain_letters(text))


def ledger_keywords(c: Column, most: int = 3) -> Column:
    """First words of the narration in capitals, a key for learning ledgers."""
    return F.upper(F.array_join(F.slice(F.split(normalised(c), " "), 1, most), " "))


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', ""))


def account_name(line: Column) -> Column:
    """What stands after the number on an "Account No" line, without a trailing currency."""
    return F.trim(F.regexp_replace(F.regexp_extract(line, r"(?i)account\s+no\.?\s*:?\s*[0-9Xx]+\s*[-:]?\s*(.*)$", 1), r"(?i)\s*\(?(INR|Rs\.?|USD)\)?\s*$", ""))
