"""Porter stems as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# The suffixes of Porter's second, third and fourth steps, and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Runs of consonants and of vowels; y is a vowel after a consonant (a first y is written Y while stemming).
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MORE_THAN_0 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
MORE_THAN_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
EXACTLY_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxyY]$"


def _without(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _longest(w: Column, suffixes: list[str], then: Callable[[Column, Column], Column]) -> Column:
    """`then` of the stem and the longest suffix that leaves a stem; the word itself if there is none."""
    return let(F.regexp_extract(w, f"^.*?({'|'.join(suffixes)})$", 1), lambda end: F.when(end == "", w).otherwise(let(_without(w, F.length(end)), lambda stem: then(stem, end))))


def _replaced(w: Column, table: dict[str, str]) -> Column:
    ends = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return _longest(w, list(table), lambda stem, end: F.when(stem.rlike(MORE_THAN_0), F.concat(stem, ends[end])).otherwise(w))


def _mended(stem: Column) -> Column:
    """A stem that lost -ed or -ing."""
    last = F.substring(stem, -1, 1)
    double = (F.lower(F.substring(stem, -2, 1)) == last) & (F.length(stem) > 1) & ~last.isin(*"aeioulsz")
    return F.when(stem.rlike("(at|bl|iz)$") | stem.rlike(SHORT_END), F.concat(stem, F.lit("e"))).when(double, _without(stem, 1)).otherwise(stem)


def porter(term: Column) -> Column:
    """The Porter stem of a lower-cased term; terms under three letters and those with signs outside a-z stay."""
    steps = [
        lambda w: F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, 2, 1_000))).otherwise(w),
        lambda w: F.when(w.rlike("(ss|i)es$"), _without(w, 2)).when(w.rlike("^.+[^s]s$"), _without(w, 1)).otherwise(w),
        lambda w: _longest(
            w, ["eed", "ed", "ing"],
            lambda stem, end: F.when(end == "eed", F.when(stem.rlike(MORE_THAN_0), _without(w, 1)).otherwise(w)).when(stem.rlike(HAS_VOWEL), _mended(stem)).otherwise(w),
        ),
        lambda w: F.when(w.rlike("^.+y$") & _without(w, 1).rlike(HAS_VOWEL), F.concat(_without(w, 1), F.lit("i"))).otherwise(w),
        lambda w: _replaced(w, STEP_2),
        lambda w: _replaced(w, STEP_3),
        lambda w: _longest(w, STEP_4, lambda stem, end: F.when(stem.rlike(MORE_THAN_1) & ((end != "ion") | stem.rlike("[st]$")), stem).otherwise(w)),
        lambda w: let(_without(w, 1), lambda stem: F.when(w.endswith("e") & (stem.rlike(MORE_THAN_1) | stem.rlike(EXACTLY_1) & ~stem.rlike(SHORT_END)), stem).otherwise(w)),
        lambda w: F.when(w.endswith("ll") & w.rlike(MORE_THAN_1), _without(w, 1)).otherwise(w),
        lambda w: F.when(w.startswith("Y"), F.concat(F.lit("y"), F.substring(w, 2, 1_000))).otherwise(w),
    ]

    def stemmed(w: Column, left: list) -> Column:
        return let(left[0](w), lambda x: stemmed(x, left[1:])) if left else w

    return F.when(term.rlike("^[a-z]{3,64}$"), stemmed(term, steps)).otherwise(term)
