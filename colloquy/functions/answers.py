"""Column expressions over questions and answers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_answer

# Phrases that make an answer an abstention.
ABSTENTIONS = ["not enough", "not supported", "cannot answer", "can't answer", "do not have enough", "don't have enough", "insufficient", "unknown", "not available", "no retrieved evidence"]
# Words that do not count when an item is compared with an answer.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "been", "for", "has", "have", "in", "is", "it", "of", "or", "the", "to", "was", "were", "with"]
# The form of a question for a date, and of terms relative to the day of writing.
TIME_QUESTION = r"^when\b|\bwhat (?:date|month|year|day)\b|\bwhich day\b"
RELATIVE_TIMES = [r"\btoday\b", r"\byesterday\b", r"\btomorrow\b", r"\b\d{1,2}\s+days?\s+ago\b", r"\blast week\b"]


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_abstention(text: Column) -> Column:
    """True for an empty answer or one with an abstaining phrase."""
    t = F.lower(_spaced(text))
    return (t == "") | F.exists(F.array(*map(F.lit, ABSTENTIONS)), lambda m: F.contains(t, m))


def is_time_question(text: Column) -> Column:
    """True for a question that asks for a date."""
    return F.lower(_spaced(text)).rlike(TIME_QUESTION)


def relative_times(text: Column) -> Column:
    """Distinct relative time terms, in the order of the list of forms."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.lower(_spaced(text)), F.lit(p), F.lit(0)) for p in RELATIVE_TIMES]))


def answer_items(text: Column) -> Column:
    """An answer cut at commas, semicolons and the word "and"."""
    return F.filter(F.transform(F.split(F.regexp_replace(_spaced(text), r"(?i) and ", ", "), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def item_tokens(text: Column) -> Column:
    """Distinct tokens without stop words; with them if nothing else is left."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9+]+"), F.lit(0)))
    kept = F.filter(every, lambda w: ~w.isin(STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def covers_item(answer: Column, item: Column, least: float = 0.67) -> Column:
    """True if the normalised item is part of the answer, or if the answer has that share of its tokens."""
    name, tokens = normalize_answer(item), item_tokens(item)
    shared = F.try_divide(F.size(F.array_intersect(tokens, item_tokens(answer))), F.size(tokens))
    return (name != "") & (F.contains(normalize_answer(answer), name) | F.coalesce(shared >= least, F.lit(False)))


@F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
def _embedded(texts: pa.Array) -> pa.Array:
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    digests = b"".join(hashlib.sha256(t.encode()).digest() for t in texts.drop_null().to_pylist())
    v = np.frombuffer(digests, np.uint8).reshape(-1, 32) / 255.0 - 0.5
    norm = np.zeros(len(v))
    for i in range(32):  # one after the other: the same sums as those of a row
        norm += v[:, i] * v[:, i]
    flat = pa.array((v / np.sqrt(norm)[:, None]).ravel())
    ends = np.concatenate(([0], np.cumsum(known) * 32)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~known))


def hash_embedding(text: Column) -> Column:
    """A unit vector of 32 numbers made from the bytes of the text's SHA-256, of a batch of texts at once."""
    return F.coalesce(_embedded(text.cast("string")), F.array_repeat(F.lit(None).cast("double"), 32))
