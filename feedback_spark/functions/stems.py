"""Porter's word endings (1980) as column expressions.

Each step finds the longest listed ending, and changes it when what is left
is long enough in the sense of the paper: its measure m counts the turns from
vowels to consonants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from feedback_spark.functions.text import let

# Shapes of what stands before an ending; y is a vowel after a consonant.
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
M_ABOVE_0 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
M_IS_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
M_ABOVE_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
ANY = ""

# Endings of the published algorithm and what replaces them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
LONG_ENDINGS = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
MIDDLE_ENDINGS = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
LAST_ENDINGS = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
)


def _ending(word: Column, endings: Iterable[str], change: Callable[[str, Column], Column]) -> Column:
    """``change(ending, what stands before it)`` for the longest of ``endings`` that ``word`` has, else ``word``.

    ``word`` must be a value, not an expression. Endings are told apart by plain comparisons, those of one last letter only where
    the word ends in it, so a pattern runs at most once, and only for a word that has an ending.
    """
    by_letter: dict[str, list[str]] = {}
    for ending in sorted(endings, key=len, reverse=True):
        by_letter.setdefault(ending[-1], []).append(ending)
    out = F.when(F.lit(False), word)
    for letter, listed in by_letter.items():
        found = F.when(F.lit(False), word)
        for ending in listed:
            found = found.when(word.endswith(ending), change(ending, F.left(word, F.length(word) - len(ending))))
        out = out.when(word.endswith(letter), found.otherwise(word))
    return out.otherwise(word)


def _swap(word: Column, endings: dict[str, str], before: str) -> Column:
    def change(w: Column) -> Column:
        def swapped(ending: str, rest: Column) -> Column:
            new = F.concat(rest, F.lit(endings[ending]))
            return new if before == ANY else F.when(rest.rlike(before), new).otherwise(w)

        return _ending(w, endings, swapped)

    return let(word, change)


def _past_and_ing(word: Column) -> Column:
    def repair(rest: Column) -> Column:
        doubled = rest.rlike(r"([^aeiouylsz])\1$")
        return (
            F.when(rest.endswith("at") | rest.endswith("bl") | rest.endswith("iz"), F.concat(rest, F.lit("e")))
            .when(doubled, F.left(rest, F.length(rest) - 1))
            .when(rest.rlike(M_IS_1) & rest.rlike(SHORT_END), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )

    def change(w: Column) -> Column:
        def cut(ending: str, rest: Column) -> Column:
            if ending == "eed":
                return F.when(rest.rlike(M_ABOVE_0), F.concat(rest, F.lit("ee"))).otherwise(w)
            return F.when(rest.rlike(HAS_VOWEL), let(rest, repair)).otherwise(w)

        return _ending(w, ("eed", "ed", "ing"), cut)

    return let(word, change)


def _last(word: Column) -> Column:
    def change(w: Column) -> Column:
        def cut(ending: str, rest: Column) -> Column:
            fits = rest.rlike(M_ABOVE_1)
            if ending == "ion":
                fits = (rest.endswith("s") | rest.endswith("t")) & fits
            return F.when(fits, rest).otherwise(w)

        return _ending(w, [*LAST_ENDINGS, "ion"], cut)

    return let(word, change)


def _tidy(word: Column) -> Column:
    def drop_e(w: Column) -> Column:
        rest = F.left(w, F.length(w) - 1)
        drop = rest.rlike(M_ABOVE_1) | (rest.rlike(M_IS_1) & ~rest.rlike(SHORT_END))
        return F.when(w.endswith("e"), F.when(drop, rest).otherwise(w)).otherwise(w)

    def single_l(w: Column) -> Column:
        rest = F.left(w, F.length(w) - 1)
        return F.when(w.endswith("ll") & rest.rlike(M_ABOVE_1), rest).otherwise(w)

    return let(let(word, drop_e), single_l)


def may_change(word: Column) -> Column:
    """False for words that end in none of the listed endings, which no step changes; told by their last two letters."""
    endings = {*PLURALS, "ed", "ing", "y", *LONG_ENDINGS, *MIDDLE_ENDINGS, *LAST_ENDINGS, "ion", "e", "ll"}
    pairs = sorted({e[-2:] for e in endings if len(e) > 1})
    last = F.substring(word, -2, 2)
    return reduce(Column.__or__, [word.endswith(e) for e in sorted(endings) if len(e) == 1], last.isin(pairs))


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay as they are."""
    out = _swap(word, PLURALS, ANY)
    out = _past_and_ing(out)
    out = _swap(out, {"y": "i"}, HAS_VOWEL)
    out = _swap(out, LONG_ENDINGS, M_ABOVE_0)
    out = _swap(out, MIDDLE_ENDINGS, M_ABOVE_0)
    return F.when(F.length(word) <= 2, word).when(~may_change(word), word).otherwise(_tidy(_last(out)))
