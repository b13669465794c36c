"""Which texts contain which surfaces: never all texts against all surfaces of a group that has many.

The texts of a group with few surfaces meet those as one row and are looked through where they meet, so that a text travels once.
In a group with many a surface is posted under one piece of it, the one that the fewest texts of its group have; a text is probed
with its pieces, and only texts that have a surface's piece are looked through. Pieces are words, or three characters where a
surface may begin and end inside words (shorter surfaces are their own piece). They travel as hashes beside the hashes that name
their text or surface, never with the text itself, which would be sent once for each of its characters. A surface with a piece that
no text has is dropped before the join. The work is linear in the texts and in what shares a surface's rarest piece; a piece is
joined with its group, so that a hot group is many keys. Pieces are many times more than the texts that a size is estimated from,
so that no side of these joins may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece.
CHARS = 3
#: Surfaces of a group, at most, that each of its texts is looked through for.
FEW = 64


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def found_in(surfaces: DataFrame, texts: DataFrame, by: str = "sample_id", words: bool = False, few: int = FEW) -> DataFrame:
    """(by, surface, text_id): the texts (by, text_id, text) of a group that contain each of its surfaces (by, surface).

    Both are normalised by the caller. With ``words`` a surface must stand between blanks or ends; an empty one then stands in
    empty texts alone, else in every text. Null texts and surfaces contain nothing and are in nothing; repeated surfaces count once.
    """
    s = surfaces.select(by, "surface").where("surface is not null").distinct()
    t = texts.select(by, "text_id", "text").where("text is not null")
    text, surface = F.col("text"), F.col("surface")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = lambda c: F.when(c == "", text == "").otherwise(F.contains(spaced(text), spaced(c))) if words else F.contains(text, c)
    counted = s.groupBy(by).agg(F.count(F.lit(1)).alias("surfaces"))
    own = s.join(counted.hint("merge"), by)
    near = own.where((F.col("surfaces") <= few) | (surface == "")).groupBy(by).agg(F.collect_list("surface").alias("asked"))
    direct = t.join(near.hint("merge"), by).select(by, F.explode(F.filter("asked", inside)).alias("surface"), "text_id")

    far = own.where((F.col("surfaces") > few) & (surface != "")).select(by, "surface", F.xxhash64("surface").alias("sid"))
    probed = t.join(counted.where(F.col("surfaces") > few).select(by).hint("merge"), by, "left_semi").withColumn("tid", F.xxhash64("text_id", "text"))
    pieces = F.split(text, " ") if words else F.concat(*(_grams(text, n) for n in range(1, CHARS + 1)))
    parts = F.split(surface, " ") if words else F.when(F.length(surface) >= CHARS, _grams(surface, CHARS)).otherwise(F.array(surface))
    hashed = lambda c: F.explode(F.array_distinct(F.transform(c, lambda p: F.xxhash64(p)))).alias("piece")
    posted = probed.select(by, "tid", hashed(pieces))
    seen = posted.groupBy(by, "piece").agg(F.count(F.lit(1)).alias("texts"))
    wanted = far.select(by, "sid", hashed(parts))
    known = wanted.join(seen.hint("merge"), [by, "piece"], "left").groupBy(by, "sid").agg(F.min_by("piece", F.struct(F.coalesce("texts", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("texts", F.lit(0))).alias("texts")).where("texts > 0").drop("texts")
    # equal hashes of different surfaces or texts only bring more to look through
    met = posted.join(known.hint("merge"), [by, "piece"]).select(by, "sid", "tid").distinct()
    both = met.join(far.hint("merge"), [by, "sid"]).join(probed.hint("merge"), [by, "tid"])
    return direct.unionByName(both.where(inside(surface)).select(by, "surface", "text_id")).distinct()
