"""Protected spans: parts of a text that a normaliser must leave alone are masked, and put back behind it.

A mask is one character of private use for each span, in their order, so that whatever changes between them, spans find
their places again by counting. A text that holds that character itself has it as a span of its own, so
``restored(masked)`` of any text is the text. An annotation holds one bar and no bracket inside, so that brackets
without an end are not tried up to the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import once

MASK = "\ue000"
# Names with a middle dot, terms with hyphens, addresses, and words with their pronunciation.
NAME = "[一-鿿]+(?:[-·—][一-鿿]+){1,2}"
TERM = "[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+"
ADDRESS = r"[a-zA-Z0-9]+@[a-zA-Z0-9]+\.[a-zA-Z]+"
ANNOTATION = r"<([^<|>\n]+)\|([^<|>\n]+)>"
#: The same so that a long run without a match is not tried from each of its characters: a match begins at the first of
#: a run, or where the one before ended, and what a run has taken it doesn't give back.
QUICK = {
    NAME: r"(?:\G|(?<![一-鿿]))[一-鿿]++(?:[-·—][一-鿿]++){1,2}",
    TERM: r"(?:\G|(?<![A-Za-z]))[A-Za-z][A-Za-z0-9]*+-(?=[A-Za-z0-9])(?:(?!-(?![A-Za-z0-9]))[A-Za-z0-9-])*+",  # one loop over characters: nested ones overflow the stack
    ADDRESS: r"(?:\G|(?<![a-zA-Z0-9]))[a-zA-Z0-9]++@[a-zA-Z0-9]++\.[a-zA-Z]++",
}
# What an annotated word becomes, by its script, and kana.
LATIN_TOKEN, HAN_TOKEN, HAN, KANA = "<|SPECIAL_TOKEN_1|>", "<|SPECIAL_TOKEN_2|>", "[一-鿿]", "^(?:[぀-ゟ]+|[゠-ヿ]+)$"
PATTERNS = (ADDRESS, r"<[^<|>\n]+\|[^<|>\n]+>", NAME, TERM)


def _grammar(patterns: tuple[str, ...]) -> str:
    return "|".join((MASK, *(QUICK.get(p, p) for p in patterns)))


def spans(text: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """The protected spans in order; where two begin together the earlier pattern counts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_grammar(patterns)), F.lit(0))


def masked(text: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _grammar(patterns), MASK)


def restored(text: Column, held: Column) -> Column:
    """A masked text with its spans back; null if masks were lost or doubled on the way."""
    whole = lambda parts, h: F.array_join(F.flatten(F.zip_with(parts, h, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    return once(held, lambda h: once(F.split(text, MASK, -1), lambda parts: F.when(F.size(parts) == F.size(h) + 1, whole(parts, h))))


def annotated(text: Column) -> Column:
    """Words with their pronunciation as the pronunciation in upper case between tokens of the word's script; kana between spaces."""
    words, sounds = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{MASK}|{ANNOTATION}"), F.lit(k)) for k in (1, 2))

    def said(word: Column, sound: Column) -> Column:
        between = lambda token: F.concat(token, sound, token)
        return F.when(word == "", MASK).when(sound.rlike(KANA), between(F.lit(" "))).when(word.rlike(HAN), between(F.lit(HAN_TOKEN))).otherwise(between(F.lit(LATIN_TOKEN)))

    return restored(F.regexp_replace(F.coalesce(text, F.lit("")), f"{MASK}|{ANNOTATION}", MASK), F.zip_with(words, sounds, lambda word, sound: once(F.upper(sound), lambda s: said(word, s))))


def annotation_issues(text: Column, most_letters: int = 40) -> Column:
    """array<struct<span, issue>>: brackets with a bar that aren't whole annotations, and those without a word, a sound or with too long a sound."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"<[^<>]*\|[^<>]*>?"), F.lit(0))
    found = F.filter(found, lambda s: ~s.rlike(rf"^<[A-Za-z]+\|[A-Za-z]{{1,{most_letters}}}>$"))  # plain ones, mostly all, have none of the issues

    def issue(span: Column) -> Column:
        word, sound = F.trim(F.regexp_extract(span, r"^<([^|]*)\|", 1)), F.trim(F.regexp_extract(span, r"\|([^>]*)", 1))
        kind = F.when(~span.endswith(">"), "not closed").when(F.length(F.regexp_replace(span, r"[^|]", "")) > 1, "several bars").when(word == "", "no word").when(sound == "", "no pronunciation")
        kind = kind.when(F.char_length(sound) > most_letters, "pronunciation too long").when(word.rlike(HAN) & sound.rlike("[A-Za-z]") & ~sound.rlike("[1-5]"), "no tone")
        return F.struct(span.alias("span"), kind.alias("issue"))

    return F.filter(F.transform(found, issue), lambda s: s["issue"].isNotNull())
