"""Quality rules with adaptive thresholds, in DataFrame functions alone.

A fixed base rule comes first. Beyond it no cutoff is a constant: quantile sketches (KLL) of four measures are built per
language and source in one pre-aggregated pass and merged to the language and to the whole corpus. The measures are
never zero for most documents, so that their quartiles tell something: symbols to words, the odds of duplicate lines,
the odds of repeated words (each with half an event added to both sides), and the mean word length.

A measure's fence lies ``REACH`` interquartile ratios beyond the quartile: q75 * (q75 / q25) ** REACH above, and for the
word length also q25 / (q75 / q25) ** REACH below. So a source that is used to symbols may have more of them than one that
has none. Up to a quarter of a group may be junk at either end without moving its fence. A document is rejected beyond
a fence of its own group. For the word length it is read with ``STEADY`` more words of the group's median length, as the
mean of a few words varies; a document without any symbol, duplicate line or repeated word is never rejected for that.

A group's quartiles are drawn towards its language's, and those towards the corpus's, as if the level above were ``PRIOR`` more
documents: no size is a switch. A level whose quartiles are equal (copies of one text) is passed over; if all are, there is no fence. ``LEAST_RATIO`` is far below the spread of
different texts: it only keeps a group of nearly equal texts from rejecting all others.

The texts are read once: measures are written to the shared folder, and sketches and verdicts are made from them.

Nulls: a null text has no words (base_failed); null languages and sources are groups of their own. Repeated rows stay and
count each time. An empty table gives no rows. A very long text costs O(n log n). Other columns pass through, except that
those with a measure's name are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Base rule: fewest words, and most words (percent) in 5-word windows that the text repeats.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Interquartile ratios from a quartile to its fence: 3 is far out; lines are few, so their odds spread more.
REACH = {"symbols": 3, "lines": 2, "repeats": 3, "length": 3}
#: Words of median length that are added to a text before its mean length is judged.
STEADY = 10
#: Documents that the quartiles of the level above weigh as much as: of 16, a quartile is off by a quarter of the interquartile
#: range (1.36 sigma / sqrt(n)); and the least interquartile ratio.
PRIOR, LEAST_RATIO = 16, 1.02
#: Accuracy of the sketches: about 50 KB each at most, exact below this many documents.
SKETCH_K = 2048
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\f\r", ""))


def line_counts(text: Column) -> Column:
    """Struct (n, d): lines with a word, and the distinct ones of them."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more, in O(n log n) for a text of n words."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1).h == e.h)) | F.coalesce(F.get(s, k + 1).h == e.h, F.lit(False)))
        places = lambda s: F.sort_array(F.transform(twice(s), lambda e: e.i))
        total = lambda p: F.aggregate(p, F.struct(F.lit(-width).alias("at"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("at"), (a.n + F.least(F.lit(width), i - a.at)).alias("n")), lambda a: a.n)
        return _let(ordered, lambda s: _let(places(s), total))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    some = _let(hashed, lambda h: _let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))
    return F.when(F.size(words) <= width, 0).otherwise(some)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, and __lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("__l", line_counts(text))
    x = x.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": word_chars(text).cast("long"), "n_symbols": symbol_count(text).cast("long"),
        "n_dup_lines": (F.col("__l.n") - F.col("__l.d")).cast("long"), "n_repeat_words": repeated_words(F.col("__w")).cast("long"), "__lines": F.col("__l.n"),
    }).drop("__w", "__l")
    return x.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _odds(part: Column, whole: Column) -> Column:
    return (part + 0.5) / (whole - part + 0.5)


def _judged_by() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "symbols": (F.col("n_symbols") + 0.5) / (n + 1), "lines": _odds(F.col("n_dup_lines"), F.col("__lines")),
        "repeats": _odds(F.col("n_repeat_words"), n), "length": F.col("word_chars") / n,
    }


def quartiles(measured: DataFrame) -> DataFrame:
    """(lang, source, symbols, lines, repeats, length): one row per language and source with the quartiles (q1, q2, q3) of
    each measure that its documents are judged by, from merged sketches."""
    seen = measured.where(F.col("n_words") >= MIN_WORDS).select("lang", "source", *(c.alias(m) for m, c in _judged_by().items()))
    group = stage(seen.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in REACH)), "sketches")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in REACH)]
    lang = stage(group.groupBy("lang").agg(*merge), "languages")

    def named(level: DataFrame, tag: str) -> DataFrame:
        q = lambda m: F.struct(*(F.kll_sketch_get_quantile_double(m, F.lit(r)).alias(f"q{k}") for k, r in ((1, 0.25), (2, 0.5), (3, 0.75))))
        return level.withColumns({f"{m}_{tag}": q(m) for m in REACH}).drop(*REACH).withColumnRenamed("n", f"n_{tag}")

    every = lang.groupBy(F.lit(0).alias("__all")).agg(*merge).drop("__all")
    x = named(group, "g").join(named(lang, "l").withColumnRenamed("lang", "__up"), F.col("lang").eqNullSafe(F.col("__up"))).crossJoin(F.broadcast(named(every, "a")))  # one row

    def pick(m: str) -> Column:
        """The group's quartiles drawn towards its language's, and those towards the corpus's, the less the more documents
        they stand on; a level with equal quartiles says nothing."""
        fits = lambda tag: F.when(F.col(f"{m}_{tag}.q1") < F.col(f"{m}_{tag}.q3"), F.col(f"{m}_{tag}"))

        def blend(own: Column, up: Column, n: str) -> Column:
            # as geometric means: fences are ratios
            mixed = F.struct(*((F.pow(own[q], F.col(n) / (F.col(n) + PRIOR)) * F.pow(up[q], F.lit(PRIOR) / (F.col(n) + PRIOR))).alias(q) for q in ("q1", "q2", "q3")))
            return F.when(own.isNull(), up).when(up.isNull(), own).otherwise(mixed)

        return blend(fits("g"), blend(fits("l"), fits("a"), "n_l"), "n_g")

    return x.select("lang", "source", *(pick(m).alias(m) for m in REACH))


def _odd() -> Column:
    """True for a document that lies beyond a fence of its group."""
    step = lambda m: F.pow(F.greatest(F.col(f"__q_{m}.q3") / F.col(f"__q_{m}.q1"), F.lit(LEAST_RATIO)), F.lit(REACH[m]))
    above = lambda m, c: c > F.col(f"__q_{m}.q3") * step(m)
    by = _judged_by()
    length = (F.col("word_chars") + STEADY * F.col("__q_length.q2")) / (F.col("n_words") + STEADY)
    some = {"symbols": "n_symbols", "lines": "n_dup_lines", "repeats": "n_repeat_words"}
    rules = [above("length", length), length < F.col("__q_length.q1") / step("length"), *((F.col(c) > 0) & above(m, by[m]) for m, c in some.items())]
    return reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules))


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with the measures, base_failed and kept."""
    own = [c for c in columns or docs.columns if c not in (*MEASURES, "kept")]
    seen = measures(docs).select(*own, *(F.col(c).alias(f"__{c}") for c in ("lang", "source")), *MEASURES, "__lines")
    seen = stage(seen, "measures")
    groups = seen.select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *MEASURES, "__lines")
    limits = stage(quartiles(groups), "quartiles").toDF("__g", "__s", *(f"__q_{m}" for m in REACH))
    x = seen.join(limits, F.col("__lang").eqNullSafe(F.col("__g")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    return x.withColumn("kept", ~F.col("base_failed") & ~_odd()).select(*own, *MEASURES, "kept")
