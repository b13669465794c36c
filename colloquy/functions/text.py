"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_answer(text: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and white space becomes a space; one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def keywords(text: Column) -> Column:
    """Distinct lower-cased words of letters, digits, hyphens and apostrophes that are longer than two."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9\-']+"), F.lit(0))), lambda w: F.length(w) > 2)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two keyword sets; 0 if either is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(n, F.size(a) + F.size(b) - n), F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded up; 0 for an empty text."""
    return F.ceil(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))) * 1.3).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Clamped to -1..1; null if the lengths differ or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def unit_cosine(a: Column, b: Column) -> Column:
    """The cosine of two unit vectors, clamped to -1..1. Those of 32 numbers, as the hash embeddings are, are summed up term by term
    in the same order, which is compiled; a function of each element is not."""
    terms = F.lit(0.0)
    for i in range(32):
        terms = terms + a[i] * b[i]
    dot = F.when((F.size(a) == 32) & (F.size(b) == 32), terms).otherwise(F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double: the same number, without going through decimals where it is not close to a half."""
    scaled = value * F.lit(10.0**digits)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(value, digits))


def hashed(words: Column) -> Column:
    """An array of words as 64-bit hashes: sets of numbers are compared many times faster than sets of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def judge_score(verdict: Column) -> Column:
    """1, 0.5 or 0; null for anything else."""
    return F.when(verdict == "correct", 1.0).when(verdict == "partial", 0.5).when(verdict == "incorrect", 0.0)


def phase_for_task(task: Column) -> Column:
    """The phase of a run that a task belongs to."""
    return (
        F.when(task.contains("judge"), "evaluation").when(task.contains("answer"), "answering")
        .when(task.contains("rerank"), "retrieval").when(task.contains("extract"), "memory").otherwise("other")
    )
