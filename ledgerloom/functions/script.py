"""Telugu script in Latin letters, by the ISO 15919 standard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 15919 for the Telugu block of Unicode, in the block's order. Consonants carry an inherent a.
VOWELS = {"అ": "a", "ఆ": "ā", "ఇ": "i", "ఈ": "ī", "ఉ": "u", "ఊ": "ū", "ఋ": "r̥", "ఌ": "l̥", "ఎ": "e", "ఏ": "ē", "ఐ": "ai", "ఒ": "o", "ఓ": "ō", "ఔ": "au", "ౠ": "r̥̄", "ౡ": "l̥̄"}
CONSONANTS = {
    "క": "k", "ఖ": "kh", "గ": "g", "ఘ": "gh", "ఙ": "ṅ", "చ": "c", "ఛ": "ch", "జ": "j", "ఝ": "jh", "ఞ": "ñ", "ట": "ṭ", "ఠ": "ṭh", "డ": "ḍ", "ఢ": "ḍh", "ణ": "ṇ",
    "త": "t", "థ": "th", "ద": "d", "ధ": "dh", "న": "n", "ప": "p", "ఫ": "ph", "బ": "b", "భ": "bh", "మ": "m", "య": "y", "ర": "r", "ఱ": "ṟ", "ల": "l", "ళ": "ḷ", "వ": "v", "శ": "ś", "ష": "ṣ", "స": "s", "హ": "h",
}
SIGNS = {"ా": "ā", "ి": "i", "ీ": "ī", "ు": "u", "ూ": "ū", "ృ": "r̥", "ౄ": "r̥̄", "ె": "e", "ే": "ē", "ై": "ai", "ొ": "o", "ో": "ō", "ౌ": "au"}
MARKS = {"ఁ": "m̐", "ం": "ṁ", "ః": "ḥ"}
VIRAMA = "్"
DIGITS = dict(zip("౦౧౨౩౪౫౬౭౮౯", "0123456789"))
#: All letters by what they add; a sign takes the place of the inherent a, the virama leaves nothing.
LETTERS = VOWELS | CONSONANTS | SIGNS | MARKS | DIGITS | {VIRAMA: ""}


def romanised(text: Column) -> Column:
    """ISO 15919 of Telugu letters, other characters as they are.

    A transducer that looks one character ahead: a consonant keeps its inherent a unless a vowel sign or the virama follows.
    """
    table = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*map(F.lit, LETTERS.values())))
    consonants, joins = "".join(CONSONANTS), "".join(SIGNS) + VIRAMA

    def spell(letters: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            follows = F.coalesce(F.get(letters, i + 1), F.lit(""))
            inherent = (c != "") & F.lit(consonants).contains(c) & ((follows == "") | ~F.lit(joins).contains(follows))
            return F.concat(F.coalesce(F.try_element_at(table, c), c), F.when(inherent, "a").otherwise(""))

        return F.array_join(F.transform(letters, one), "")

    return F.get(F.transform(F.array(F.split(text, "")), spell), 0)
