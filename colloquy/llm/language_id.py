"""Language identification in two steps: the family by one-versus-rest linear SVMs, then the language by one-versus-one
linear SVMs between the languages of that family.

Features are hashed byte n-grams (2, 3 and 4) of the lower-cased text with everything but letters as a space, as shares
of the text's n-grams; a score is the mean of a weight over a text's n-grams, so a whole column is scored in numpy
without a matrix. The SVMs are fitted in the dual on a bounded sample: of the ``LANGUAGES`` languages with the most
documents (ties by name) at most ``PER_LANGUAGE`` texts each and ``IN_ALL`` together, those with the least hash of their id
(ties by id); of rows with one id and language, the least text. The Gram matrix on the driver has ``IN_ALL`` rows at most. Every text is then scored, a very long one as a
whole; of equally good languages the first by name is taken.

Nulls: a null text, or one without letters, is ``und`` with score 0; a null language or id is never learned from.
Equal texts get equal answers. Without any row to learn from, everything is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import small, stage
from .wordhash import chunks, column_bytes

#: Rows to learn from, at most, for each language and in all; languages to learn, at most: those of the most documents.
PER_LANGUAGE, IN_ALL, LANGUAGES = 256, 4096, 256
#: Buckets of each n-gram length.
BUCKETS = 4096
#: Shares of a language in which those rows are ranked first.
SHARES = 8
LENGTHS = (2, 3, 4)
# ISO 639-1 codes by family; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu ne",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def ngram_buckets(data: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
    """For each n-gram length a row with the bucket of the n-gram that starts at each byte.

    ``offs`` (from 0) says where the texts of ``data`` lie: an n-gram that runs over a text's end reads spaces there.
    """
    buf = np.full(len(data) + 8, 32, np.uint8)
    buf[: len(data)] = np.where(_LETTER[data], data, 32)
    fours = np.lib.stride_tricks.as_strided(buf[:4].view(np.uint32), shape=(len(data),), strides=(1,))
    if offs is not None:
        fours, sizes = fours.copy(), np.diff(offs)
        for left in range(1, max(LENGTHS)):
            at = offs[1:][sizes >= left] - left
            fours[at] = fours[at] & np.uint32((1 << 8 * left) - 1) | np.uint32(0x20202020 << 8 * left & 0xFFFFFFFF)
    out = np.empty((len(LENGTHS), len(data)), np.int32)
    for k, n in enumerate(LENGTHS):
        x = (fours & np.uint32((1 << 8 * n) - 1)) * np.uint32(2654435761)
        out[k] = (x >> np.uint32(32 - 12)) + k * BUCKETS
    return out


def _scored(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each text's n-grams, one column for each row of ``weights``; 0 for an empty text."""
    data, offs = column_bytes(pc.utf8_lower(texts))
    out = np.zeros((len(offs) - 1, len(weights)))
    for a, b in chunks(offs):
        n = np.diff(offs[a : b + 1])
        full = np.flatnonzero(n)
        if not len(full):
            continue
        where = ngram_buckets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        for m, w in enumerate(weights):
            per_byte = w[where[0]] + w[where[1]] + w[where[2]]
            out[a + full, m] = np.add.reduceat(per_byte, (offs[a:b] - offs[a])[full], dtype=np.float64) / (len(LENGTHS) * n[full])
    return out


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = column_bytes(pc.utf8_lower(b.column("text")))
        rows = []
        for a, e in zip(offs[:-1], offs[1:], strict=True):
            counts = np.bincount(ngram_buckets(data[a:e]).ravel(), minlength=len(LENGTHS) * BUCKETS)
            rows.append((counts / max(1, counts.sum())).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(rows, pa.binary())], ["lang", "shares"])


def fit_svm(gram: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 60, seed: int = 0) -> np.ndarray:
    """Dual coefficients (times y) of a linear SVM with squared hinge loss, by coordinate descent on the Gram matrix."""
    a, f, rng = np.zeros(len(y)), np.zeros(len(y)), np.random.default_rng(seed)
    weight = c * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = max(-a[i], -(y[i] * f[i] - 1 + a[i] / (2 * weight[i])) / (gram[i, i] + 1 / (2 * weight[i])))
            if step:
                a[i] += step
                f += step * y[i] * gram[:, i]
    return a * y


class Model:
    """Weight rows with their biases: one for each family (if there are several), one for each pair within a family."""

    def __init__(self, langs: list[str], x: np.ndarray):
        self.langs = sorted(set(langs))
        family = np.array([_FAMILY.get(v, v) for v in langs]) if langs else np.zeros(0, str)
        lang = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: [v for v in self.langs if _FAMILY.get(v, v) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        rows, bias = [], []
        if len(x):  # in place: the sample is the largest thing that the driver holds
            scale = 1 / np.sqrt(x.mean(0) + np.float32(1e-7))
            x *= scale
            unit = np.float32(np.sqrt(np.einsum("ij,ij->i", x, x).mean()))
            x /= unit
            gram = (x @ x.T).astype(float) + 1.0

            def fit(keep, y):
                coef = np.zeros(len(x), np.float32)
                coef[keep] = fit_svm(gram[np.ix_(keep, keep)], y[keep].astype(float))
                rows.append((coef @ x) / unit * scale)
                bias.append(float(coef.sum()))

            for f in self.families if len(self.families) > 1 else []:
                fit(np.arange(len(x)), np.where(family == f, 1, -1))
            for a, b in self.pairs:
                fit(np.flatnonzero((lang == a) | (lang == b)), np.where(lang == a, 1, -1))
        self.weights, self.bias = np.array(rows, np.float32), np.array(bias)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        margins = _scored(texts, self.weights) + self.bias if len(self.weights) else np.zeros((len(texts), 0))
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        n_family = len(self.families) if len(self.families) > 1 else 0
        best = margins[:, :n_family].argmax(1) if n_family else np.zeros(len(texts), int)
        score = sure(margins[np.arange(len(texts)), best]) if n_family else np.ones(len(texts))
        out = np.full(len(texts), "und", object)
        for k, f in enumerate(self.families):
            here, names = np.flatnonzero(best == k), self.members[f]
            votes, total = np.zeros((len(here), len(names))), np.zeros((len(here), len(names)))
            for p, (a, b) in enumerate(self.pairs):
                if a in names:
                    m = sure(margins[here, n_family + p])
                    for name, s in ((a, m), (b, 1 - m)):
                        votes[:, names.index(name)] += s > 0.5
                        total[:, names.index(name)] += s / max(1, len(names) - 1)
            won = (votes + total / 2).argmax(1)  # most duels, ties by the summed certainty
            out[here] = np.array(names, object)[won]
            if len(names) > 1:
                score[here] *= total[np.arange(len(here)), won]
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        out[~letters], score = "und", np.where(letters & (out != "und"), score, 0.0)
        return out.tolist(), np.clip(score, 0, 1)


def held_out(id_col) -> F.Column:
    """True for the quarter of documents that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits the model on a bounded sample: at most ``per_language`` documents of each language, ``IN_ALL`` of all."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang")
    largest = [r[0] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    # ids that repeat count once: the sample is bounded in rows
    ids, per_language = ids.where(F.col("lang").isin(largest)).distinct(), min(per_language, IN_ALL // max(1, len(largest)))
    least = lambda x, *by: x.withColumn("k", F.row_number().over(Window.partitionBy("lang", *by).orderBy("o", "doc_id"))).where(F.col("k") <= per_language)
    # first in shares of each language, so that no task ranks a whole language
    shares = least(ids.withColumn("o", F.xxhash64("doc_id")).withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARES))), "share")
    chosen = stage(least(shares.select("doc_id", "lang", "o")).select("doc_id", "lang"), "sample")
    texts = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(small(chosen, 48), ["doc_id", "lang"], "left_semi")
    one = texts.where(F.col("text").rlike(r"\p{L}")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    made = one.select("lang", "text").mapInArrow(_shares, "lang string, shares binary")
    rows = sorted(made.collect())  # at most per_language rows of 24 KB for each language, whatever repeats
    x = np.empty((len(rows), len(LENGTHS) * BUCKETS), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r[1], np.float16)
    langs = [r[0] for r in rows]
    del rows
    return Model(langs, x)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` plus lang_pred and score."""
    model = model or train(docs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names[:-1], "lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    seen = docs.select(*own, F.col("text").cast("string").alias("__text"))
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    return seen.mapInArrow(add, schema)


def identified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    slim = docs.select("doc_id", "lang", "text")
    model = train(slim)
    return predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
