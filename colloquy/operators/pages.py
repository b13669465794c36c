"""Pages: groups of trajectories under a key, which a question is routed by."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import ordered, shown
from .reports import medium_chunks

#: Trajectories of a broad page, of a page at most, the pages of a sample, and the share of a topic that makes it redundant.
BROAD, WIDEST, MOST_PAGES, REDUNDANT = 24, 6, 24, 0.8
PRIORITY = {"index": 0, "entity": 1, "inventory": 2, "entity_family": 3, "topic": 4, "history": 5, "rescue": 6}
_KEY = ["sample_id", "seed_type", "seed_key"]


def _rows() -> Column:
    return F.count(F.lit(1))


def page_seeds(signals: DataFrame, keywords_each: int = 3, least: int = 2) -> DataFrame:
    """(sample_id, seed_type, seed_key, trajectory_id, broad): an index of all, a page for each name and each of the first
    keywords that ``least`` trajectories share, and one for a name's trajectories with lists. Signals: names, items, terms."""
    one = lambda kind, key: signals.select("sample_id", F.lit(kind).alias("seed_type"), key.alias("seed_key"), "trajectory_id", F.size("items").alias("listed"))
    first = F.slice("terms", 1, keywords_each)
    rows = one("index", F.lit("all")).unionByName(one("entity", F.explode("names"))).unionByName(one("inventory", F.explode("names")).where("listed > 0")).unionByName(one("topic", F.explode(first)))
    rows = rows.drop("listed").distinct()
    n = rows.groupBy(*_KEY).agg(_rows().alias("n"))
    good = n.where(F.col("seed_type").isin("index", "inventory") | (F.col("n") >= least)).select(*_KEY, ((F.col("seed_type") == "entity") & (F.col("n") > BROAD)).alias("broad"))
    return rows.join(good, _KEY)


def split_by_family(seeds: DataFrame, families: DataFrame, broad: int) -> DataFrame:
    """Pages of more than ``broad`` trajectories by entity and family (trajectory_id, family), where two share both."""
    wide = seeds.where("seed_type = 'entity'").groupBy("sample_id", "seed_key").agg(_rows().alias("n")).where(F.col("n") > broad)
    x = seeds.where("seed_type = 'entity'").join(wide, ["sample_id", "seed_key"], "left_semi").join(families, "trajectory_id")
    x = x.select("sample_id", F.concat_ws("/", "seed_key", "family").alias("seed_key"), "trajectory_id").distinct()
    return x.withColumn("n", _rows().over(Window.partitionBy("sample_id", "seed_key"))).where("n >= 2").select("sample_id", F.lit("entity_family").alias("seed_type"), "seed_key", "trajectory_id")


def without_redundant_topics(seeds: DataFrame) -> DataFrame:
    """Seeds without the topics of which ``REDUNDANT`` or more lies inside one entity or inventory page."""
    topics = seeds.where("seed_type = 'topic'").select("sample_id", "seed_key", "trajectory_id")
    others = seeds.where(F.col("seed_type").isin("entity", "inventory")).select("sample_id", "trajectory_id", F.concat_ws("/", "seed_type", "seed_key").alias("other"))
    size = topics.groupBy("sample_id", "seed_key").agg(_rows().alias("n"))
    inside = topics.join(others, ["sample_id", "trajectory_id"]).groupBy("sample_id", "seed_key", "other").agg(_rows().alias("m"))
    gone = inside.join(size, ["sample_id", "seed_key"]).where(F.col("m") >= REDUNDANT * F.col("n")).select("sample_id", "seed_key", F.lit("topic").alias("seed_type")).distinct()
    return seeds.join(gone, _KEY, "left_anti")


def singleton_policy(seeds: DataFrame, generic: list[str]) -> DataFrame:
    """Pages of one trajectory: allowed if a token of their key is longer than three letters and not generic."""
    x = seeds.where("seed_type <> 'index'").groupBy(*_KEY).agg(_rows().alias("n")).where("n = 1")
    good = F.exists(F.split("seed_key", "[ /]"), lambda w: (F.length(w) > 3) & ~w.isin(generic))
    return x.select(*_KEY, F.when(good, "allowed").otherwise("must_merge").alias("policy"))


def coverage_audit(seeds: DataFrame) -> DataFrame:
    """Seeds plus rescue pages (chunks) for trajectories that only an index lists, and pages wider than ``WIDEST`` cut into
    chunks; (sample_id, seed_type, seed_key, chunk, trajectory_id)."""
    rest = seeds.where("seed_type <> 'index'")
    alone = seeds.where("seed_type = 'index'").join(rest, ["sample_id", "trajectory_id"], "left_anti").select("sample_id", "trajectory_id")
    rescue = medium_chunks(alone, "sample_id", "trajectory_id").select("sample_id", F.lit("rescue").alias("seed_type"), F.lit("rescue").alias("seed_key"), "chunk", "trajectory_id")
    key = F.concat_ws("\x1f", F.col("sample_id").cast("string"), "seed_type", "seed_key")
    cut = medium_chunks(rest.withColumn("g", key), "g", "trajectory_id")
    pages = rest.withColumn("g", key).join(cut, ["g", "trajectory_id"]).select("sample_id", "seed_type", "seed_key", "chunk", "trajectory_id")
    return pages.unionByName(rescue)


def coverage_counts(seeds: DataFrame, audited: DataFrame) -> DataFrame:
    """Per sample: trajectories, those on the index alone before, pages before and after, and the widest page after."""
    before = seeds.where("seed_type <> 'index'").groupBy("sample_id").agg(F.countDistinct("seed_type", "seed_key").alias("pages_before"), F.countDistinct("trajectory_id").alias("listed"))
    width = audited.groupBy("sample_id", "seed_type", "seed_key", "chunk").agg(_rows().alias("w"))
    after = width.groupBy("sample_id").agg(_rows().alias("pages_after"), F.max("w").alias("widest"))
    n = seeds.where("seed_type = 'index'").groupBy("sample_id").agg(F.countDistinct("trajectory_id").alias("trajectories"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(before, "sample_id", "left").join(after, "sample_id", "left").select("sample_id", "trajectories", (F.col("trajectories") - zero("listed")).alias("index_only"), zero("pages_before").alias("pages_before"), zero("pages_after").alias("pages_after"), zero("widest").alias("widest"))


def capped_seeds(seeds: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The pages of a sample up to ``most``: by kind, then the wider, then by key; the cap is the feature."""
    order = F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))[F.col("seed_type")]
    x = seeds.groupBy(*_KEY).agg(_rows().alias("width"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(order, F.desc("width"), "seed_key"))
    return x.withColumn("place", place).where(F.col("place") <= most)


def page_links(seeds: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept pages of a sample that share trajectories; at most ``MOST_PAGES`` pages of a sample meet."""
    x = seeds.join(kept.select(*_KEY, "place"), _KEY).where("seed_type <> 'index'").select("sample_id", "trajectory_id", "place").distinct()
    y = x.withColumnRenamed("place", "linked")
    return x.join(y, ["sample_id", "trajectory_id"]).where("place < linked").groupBy("sample_id", "place", "linked").agg(_rows().alias("shared"))


def page_metadata(seeds: DataFrame, signals: DataFrame, most: int = 3, examples: int = 4) -> DataFrame:
    """Per page its most frequent names, values and terms (ties by name) and its richest trajectories."""
    fields = ("names", "values", "terms")
    rich = F.size("names") + F.size("values") + F.size("items") + F.size("terms")
    s = signals.select("trajectory_id", rich.alias("rich"), *fields)
    # a page lies in one sample: its trajectories' lists are dealt once, and all counts are made where they then are
    own = seeds.join(s.drop("rich"), "trajectory_id").select(*_KEY, *fields).repartition("sample_id")
    marked = lambda f: F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("field"), v.alias("v")))
    v = own.select(*_KEY, F.inline(F.concat(*map(marked, fields)))).groupBy(*_KEY, "field", "v").agg(_rows().alias("n"))
    v = v.withColumn("r", F.row_number().over(Window.partitionBy(*_KEY, "field").orderBy(F.desc("n"), "v"))).where(F.col("r") <= most)
    lists = v.groupBy(*_KEY, "field").agg(ordered(F.col("v"), "r").alias("list"))
    top = lists.groupBy(*_KEY).agg(*(F.max(F.when(F.col("field") == f, F.col("list"))).alias(f) for f in fields))
    x = seeds.join(s.select("trajectory_id", "rich"), "trajectory_id")
    r = x.withColumn("r", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("rich"), "trajectory_id"))).where(F.col("r") <= examples)
    r = r.groupBy(*_KEY).agg(ordered(F.col("trajectory_id"), "r").alias("representatives"))
    n = seeds.groupBy(*_KEY).agg(_rows().alias("width"))
    return n.join(r, _KEY).join(top, _KEY, "left")


def page_texts(metadata: DataFrame) -> DataFrame:
    """A page's text for readers and the one it is routed by."""
    head = F.concat(F.lit("# "), "seed_type", F.lit(": "), "seed_key")
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), F.coalesce(F.array_join(F.transform(c, lambda v: v.cast("string")), ", "), F.lit("")))
    text = F.concat_ws("\n", head, F.concat(F.lit("- width: "), F.col("width").cast("string")), line("names", "names"), line("values", "values"), line("terms", "terms"), line("trajectories", "representatives"))
    route = F.array_join(F.array_distinct(F.concat(F.array("seed_key"), F.coalesce("names", F.array().cast("array<string>")), F.coalesce("terms", F.array().cast("array<string>")))), " ")
    return metadata.select(*_KEY, text.alias("text"), route.alias("routing"))


def history_pages(cards: DataFrame, seeds: DataFrame) -> DataFrame:
    """Backup pages of the surfaces (sample_id, trajectory_id, drifted) that trajectories once had and no page is keyed by."""
    x = cards.select("sample_id", "trajectory_id", F.explode("drifted").alias("seed_key"))
    return x.join(seeds.select("sample_id", "seed_key").distinct(), ["sample_id", "seed_key"], "left_anti").select("sample_id", F.lit("history").alias("seed_type"), "seed_key", "trajectory_id").distinct()


def fragmentation_by_type(seeds: DataFrame) -> DataFrame:
    """Per sample and kind of page: pages, singletons, mean and largest width, and pages wider than ``WIDEST``."""
    w = seeds.where("seed_type <> 'index'").groupBy(*_KEY).agg(_rows().alias("w"))
    return w.groupBy("sample_id", "seed_type").agg(_rows().alias("pages"), F.round(F.avg((F.col("w") == 1).cast("double")), 9).alias("singleton_rate"), F.round(F.avg("w"), 9).alias("mean_width"), F.max("w").alias("max_width"), F.count_if(F.col("w") > WIDEST).alias("overwide"))


def split_by_vectors(members: DataFrame, cap: int = WIDEST) -> DataFrame:
    """(page, member, richness, vector) -> (page, member, part): a page of n members wider than ``cap`` in ceil(n / cap) parts.

    The richest member is the first centre, then always the one farthest from all centres; the others, richest first, go to
    the part whose members hold the closest one, if it has room. Pages are bounded by the trajectories of a sample.
    """

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["richness", "member"], ascending=[False, True]).reset_index(drop=True)
        n = len(rows)
        v = np.array(rows.vector.tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near = np.round(v @ v.T, 9)
        centres = [0]
        while len(centres) < -(-n // cap):
            far = near[:, centres].max(1)
            far[centres] = np.inf
            centres.append(int(far.argmin()))
        parts = [[c] for c in centres]
        for i in range(n):
            if i not in centres:
                room = [p for p in range(len(parts)) if len(parts[p]) < cap]
                parts[max(room, key=lambda p: (near[i, parts[p]].max(), -p))].append(i)
        part = {i: p for p, own in enumerate(parts) for i in own}
        return pd.DataFrame({"page": key[0], "member": rows.member, "part": [part[i] for i in range(n)]})

    return members.groupBy("page").applyInPandas(split, "page long, member long, part long")


def merge_small(groups: DataFrame, least: int = 3, cap: int = WIDEST) -> DataFrame:
    """(sample_id, page, member, terms) -> (sample_id, page, member): pages of fewer than ``least`` members, smallest first,
    join the page with the most terms in common that has room (ties by id); one without such a page stays."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = {p: set(g.member) for p, g in rows.groupby("page")}
        words = {p: set().union(*map(set, g.terms)) for p, g in rows.groupby("page")}
        for p in sorted(own, key=lambda q: (len(own[q]), q)):
            if len(own[p]) >= least:
                continue
            fits = [q for q in own if q != p and own[q] and len(own[q] | own[p]) <= cap and words[q] & words[p]]
            if fits:
                q = max(fits, key=lambda q: (len(words[q] & words[p]), -q))
                own[q] |= own[p]
                words[q] |= words[p]
                own[p] = set()
        return pd.DataFrame([(key[0], p, m) for p, members in own.items() for m in sorted(members)], columns=["sample_id", "page", "member"])

    return groups.groupBy("sample_id").applyInPandas(merge, "sample_id long, page long, member long")


def show_page(frame: DataFrame, *lists: str) -> DataFrame:
    """Array columns as text."""
    return frame.withColumns({c: shown(c) for c in lists})


