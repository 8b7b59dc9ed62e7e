"""Analyzers and scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that judging queries drop.
JUDGE_STOP_WORDS = "a an and the or of to in on at by for with from is are was were be been being it its as that this these those news article search query".split()
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Standard analyzer: maximal runs of letters and digits, lower-cased, in order; no stop words, no stemming."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda t: t != "")


def judge_tokens(text: Column) -> Column:
    """Analyzer of the judges: tokens of at least three bytes."""
    return F.filter(tokens(text), lambda t: F.octet_length(t) >= 3)


def judge_terms(text: Column) -> Column:
    """Query side of the judges: distinct tokens without stop words, sorted."""
    stop = F.array(*[F.lit(w) for w in JUDGE_STOP_WORDS])
    return F.array_sort(F.array_except(F.array_distinct(judge_tokens(text)), stop))


def padded(toks: Column) -> Column:
    """Tokens as one string in which every token stands between blanks; a phrase is then a substring."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def term_count(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == term))


def has_phrase(toks: Column, words: list[str]) -> Column:
    return F.contains(padded(toks), F.lit(f" {' '.join(words)} "))


def positions(toks: Column, term: str) -> Column:
    """Places of a term, from 0."""
    return F.filter(F.transform(toks, lambda t, i: F.when(t == term, i)), lambda i: i.isNotNull())


def within_distance(toks: Column, first: str, second: str, distance: int) -> Column:
    """Whether second occurs exactly ``distance`` places behind first."""
    return F.arrays_overlap(F.transform(positions(toks, first), lambda i: i + distance), positions(toks, second))


def near(toks: Column, first: str, second: str, distance: int) -> Column:
    """Whether two different terms occur at most ``distance`` places apart, in any order."""
    around = F.flatten(F.transform(positions(toks, first), lambda i: F.sequence(i - distance, i + distance)))
    return F.arrays_overlap(around, positions(toks, second))


def round4(x: Column) -> Column:
    return F.floor(x * 10_000 + 0.5) / 10_000


def trigrams(text: Column) -> Column:
    """Set of letter trigrams of each word, lower-cased and padded with two blanks before and one behind."""
    per_word = F.transform(tokens(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(per_word))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    common, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(union > 0, common / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for null, empty, unequally long or zero vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def snippet(text: Column, term: str, around: int = 40) -> Column:
    """The first place of a term with its surroundings, the term in brackets; null without it."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit("["), F.substring(text, at, F.lit(len(term))), F.lit("]"), F.substring(text, at + len(term), F.lit(around))))


def headline(text: Column, terms: list[str], before: int = 40, length: int = 160) -> Column:
    """A stretch of text from a little before the first of the terms, all terms in it in brackets; null without any. Terms are letters and digits."""
    either = "|".join(terms)
    at = F.regexp_instr(F.lower(text), F.lit(rf"\b({either})\b"))
    cut = F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length))
    return F.when(at > 0, F.regexp_replace(cut, rf"(?i)\b({either})\b", "[$1]"))
