"""Column expressions that classify questions, texts and dates by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of a mere acknowledgement, and what makes an utterance worth keeping, in order.
ACKNOWLEDGEMENTS = ["bye", "goodbye", "great", "later", "no", "noted", "ok", "okay", "see", "soon", "sounds", "sure", "talk", "thank", "thanks", "understood", "yes", "you"]
SALIENT = [
    ("place_or_area_fact", r"(?i)\b(?:old area|home\s*town|hometown|home country|neighbou?rhood|county|city|place|area|near|lives? in|moved to|moved from|returned from|came back from)\b"),
    ("incident_or_infrastructure_fact", r"(?i)\b(?:flood|storm|fire|accident|earthquake|hit|damaged|ruined|power cut|infrastructure|roadways?|housing|homes?)\b"),
    ("plan_goal_or_state_change", r"(?i)\b(?:want(?:s)? to|goal(?:s)?|number one goal|focusing on|focus(?:ed)? on|improv(?:e|ing)|better|plan(?:s|ned|ning)?|working on|joined|donated|volunteered|moved|graduated|started|stopped)\b"),
    ("family_or_adoption_fact", r"(?i)\b(?:adoption agencies|adoption agency|adopt(?:ion|ing)?|family|loving home|kids who need|children in need)\b"),
    ("media_title_or_recommendation_fact", "(?i)(?:[\"“”'][^\"“”']{2,80}[\"“”']|\\b(?:book|books|novel|novels|series|movie|film|tv show|show|read|reading|watched|watching|recommend(?:ed|ing)?|favorites?|collection)\\b)"),
    ("list_item_or_inventory_fact", r"(?i)\b(?:bought|buy|refurbished|equipment|headphones|mouse|desk|keyboard|hats?|turtles?|dogs?|breeds?|lab mixes?|chihuahua mixes?|snacks?|soda|candy|seltzer|chocolate|popcorn|fruit|veggies?|salad|energy balls?|candles?|oils?|essential oils?)\b"),
    ("method_or_technique_fact", r"(?i)\b(?:technique|techniques|strategy|strategies|method|methods|schedule|to-do list|todo list|pomodoro|eisenhower|matrix|bullet journal|time management)\b"),
    ("activity_or_practice_fact", r"(?i)\b(?:yoga|aerial yoga|kundalini|martial arts?|kickboxing|taekwondo|board games?|wine tasting|shelter|homeless shelter|pet shelter|hobbies?|relax|calming|destress|de-stress|long drives?|fixing cars?|camp(?:ed|ing)?|hiking|beach|mountains?|forest)\b"),
    ("image_adjacent_fact", r"(?i)\[(?:shared image|image):|shared image:|photo of|picture of|look at (?:this|these|that)|take a look"),
    ("capitalized_place_like_term", r"\b[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){0,3}\s+(?:County|City|River|Lake|Park|School|Center|Centre|Road|Street|Hospital|Shelter|Neighbourhood|Neighborhood)\b"),
]
# Words of a comparison, and numbers up to ten.
COMPARISONS = [" both ", " compared ", " compare ", " same ", " different ", " together ", " shared "]
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_COUNT = r"\d{1,2}|" + "|".join(NUMBERS)
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def dedupe_preserve(values: Column) -> Column:
    """The first of each value that differ by more than case and outer blanks, in order; empty ones go."""
    tidy = F.filter(F.transform(values, lambda v: spaced(v)), lambda v: v != "")
    keys = F.transform(tidy, lambda v: F.lower(v))
    return F.filter(F.transform(tidy, lambda v, i: F.when(F.array_position(keys, F.lower(v)) == i + 1, v)), lambda v: v.isNotNull())


def l2_normalized(vector: Column) -> Column:
    """The vector over its norm; null if that is 0."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda v: v.cast("double") / norm))


def readable_value(text: Column, fillers=("thing", "things", "something", "stuff", "it", "that"), endings=("the", "a", "of", "and", "to", "in")) -> Column:
    """False for an empty value, a filler or generic single word, and one that breaks off at a stop word."""
    t = F.lower(spaced(text))
    last = F.element_at(F.split(t, " "), -1)
    return (t != "") & ~t.isin(list(fillers)) & ~last.isin(list(endings)) & (F.length(t) > 2)


def readable_claim(text: Column) -> Column:
    """A claim needs three tokens and must be a readable value."""
    return readable_value(text) & (F.size(F.split(spaced(text), " ")) >= 3)


def query_shape(question: Column, names: Column, families: dict[str, str]) -> Column:
    """Struct (counting, duration, comparison, several, listing, family) of a question and the names in it. ``families``
    maps a family to the expression of its words; all but count and type make a list."""
    q = F.lower(spaced(question))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    counting = q.startswith("how many") | has([" how many ", " number of ", " count of "]) | q.startswith("number of ")
    duration = q.rlike(r"\bhow\s+many\s+(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b.*\b(passed|pass|took|take|since|between|after|before|until|from)\b")
    family = F.lit(None).cast("string")
    for name, words in reversed(families.items()):
        family = F.when(q.rlike(words), name).otherwise(family)
    listing = has([" both ", " all "]) | F.coalesce(~family.isin("count", "type"), F.lit(False))
    return F.struct(counting.alias("counting"), duration.alias("duration"), has(COMPARISONS).alias("comparison"), ((F.size(names) >= 2) | F.contains(q, F.lit(" both "))).alias("several"), listing.alias("listing"), family.alias("family"))


def query_facets(question: Column) -> Column:
    """Sorted facet tags of a question."""
    q = F.lower(question)
    tags = {
        "relationship_status": q.contains("relationship status"), "gender_identity": q.contains("identity") | q.contains("transgender"), "home_country": q.contains("home country") | q.contains("moved from") | q.contains("move from"),
        "research_topic": q.contains("research"), "art_style": q.contains("kind of art") | q.contains("art style"), "event_type": q.contains("workshop") | q.contains("event"), "activity_location": question.rlike(r"\b(?:in|from) [A-Z][a-z]+") | q.contains("where "),
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(c, t) for t, c in tags.items()))))


def location_value(question: Column) -> Column:
    """The capitalised word behind "in" or "from"; null if there is none."""
    return F.nullif(F.regexp_extract(question, r"\b(?:in|from) ([A-Z][a-z]+)", 1), F.lit(""))


def salience(text: Column) -> Column:
    """Why an utterance is worth keeping; "none" for one that is not, or that only acknowledges."""
    t = spaced(text)
    tokens = F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    polite = (F.size(tokens) > 0) & (F.size(tokens) <= 8) & F.forall(tokens, lambda w: w.isin(ACKNOWLEDGEMENTS))
    reason = F.lit("none")
    for name, pattern in reversed(SALIENT):
        reason = F.when(t.rlike(pattern), name).otherwise(reason)
    return F.when((t == "") | polite, "none").otherwise(reason)


def _number(word: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))))[word], word.try_cast("int"))


def relative_anchors(text: Column, day: Column) -> Column:
    """Array of (term, resolved, kind, granularity): relative times of a text resolved against the day it was written."""
    t = F.lower(spaced(text))
    fuzzy_form = rf"\b(?:(?:around|about)\s+(?:{_COUNT})\s+years?\s+ago|a\s+few\s+years?\s+ago)\b"
    plain = F.regexp_replace(t, fuzzy_form, "#")
    date = lambda d: F.date_format(d, "d MMMM yyyy")
    month = lambda d: F.date_format(d, "MMMM yyyy")
    clipped = F.make_date(F.year(day), F.month(day), F.least(F.dayofmonth(day), F.lit(28)))
    row = lambda term, to, kind, grain: F.struct(term.alias("term"), to.alias("resolved"), F.lit(kind).alias("kind"), F.lit(grain).alias("granularity"))
    one = lambda word, to, kind, grain: F.when(t.rlike(rf"\b{word}\b".replace(" ", r"\s+")), F.array(row(F.lit(word), to, kind, grain))).otherwise(F.array().cast("array<struct<term:string,resolved:string,kind:string,granularity:string>>"))
    found = lambda source, form: F.array_distinct(F.regexp_extract_all(source, F.lit(form), F.lit(0)))
    first = lambda m: _number(F.regexp_extract(m, r"^(\S+)", 1))
    ago = lambda unit: found(plain, rf"\b(?:{_COUNT})\s+{unit}s?\s+ago\b")
    return F.concat(
        one("today", date(day), "exact_date", "day"), one("yesterday", date(F.date_sub(day, 1)), "exact_date", "day"), one("tomorrow", date(F.date_add(day, 1)), "exact_date", "day"),
        F.transform(ago("day"), lambda m: row(m, date(F.date_sub(day, first(m))), "exact_date", "day")),
        one("last week", F.concat(F.lit("the week before "), date(day)), "relative_span", "week_span"),
        F.transform(found(t, rf"\blast\s+(?:{_DAYS})\b"), lambda m: row(F.regexp_replace(m, r"\s+", " "), F.concat(F.lit("the "), F.initcap(F.regexp_extract(m, r"(\S+)$", 1)), F.lit(" before "), date(day)), "relative_span", "weekday_span")),
        one("last month", month(F.add_months(clipped, -1)), "month_year", "month"), one("last year", (F.year(day) - 1).cast("string"), "year", "year"),
        F.transform(found(t, fuzzy_form), lambda m: row(m, m, "fuzzy_relative", "fuzzy")),
        F.transform(ago("month"), lambda m: row(m, month(F.add_months(clipped, -first(m))), "month_year", "month")),
        F.transform(ago("year"), lambda m: row(m, month(F.add_months(clipped, -12 * first(m))), "month_year", "month")),
        F.transform(ago("week"), lambda m: row(m, F.concat_ws(" ", F.regexp_extract(m, r"^(\S+)", 1), F.when(first(m) == 1, "week").otherwise("weeks"), F.lit("before"), date(day)), "relative_span", "week_span")),
    )


def temporal_match(expression: Column, text: Column) -> Column:
    """True if a text restates a relative time: literally, as "previous" for "last", as "before" or "prior to" for "ago", or
    with the number written the other way. An empty expression is met by every text."""
    e, t = F.lower(spaced(expression)), F.lower(spaced(text))
    inside = lambda p: F.regexp_like(t, p)
    unit = F.regexp_extract(e, rf"^last (week|{_DAYS}|weekend|month|year|night|summer|winter|spring|fall|autumn)$", 1)
    last = inside(F.concat(F.lit(r"\b(last|previous) "), unit, F.lit(r"\b|\b"), unit, F.lit(r" (before|prior to)\b")))
    fuzzy = rf"\b((about|around) ({_COUNT}) years? ago|a few years? ago)\b"
    n, what = F.regexp_extract(e, rf"^({_COUNT}) (day|week|month|year)s? ago$", 1), F.regexp_extract(e, rf"^({_COUNT}) (day|week|month|year)s? ago$", 2)
    same = F.array_join(F.array_union(F.array(_number(n).cast("string")), F.filter(F.array(*map(F.lit, NUMBERS)), lambda w: _number(w) == _number(n))), "|")
    ago = inside(F.concat(F.lit(r"\b("), same, F.lit(") "), what, F.lit(r"s? (ago|before|prior to)\b")))
    literal = F.contains(F.concat(F.lit(" "), F.regexp_replace(t, r"[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), e, F.lit(" ")))
    ruled = F.when(unit != "", last).when(F.regexp_like(e, F.lit(rf"^(?:{fuzzy[2:-2]})$")), inside(F.lit(fuzzy))).when(what != "", ago).otherwise(F.lit(False))
    return F.when(e == "", True).when(t == "", False).otherwise(literal | F.coalesce(ruled, F.lit(False)))


def scoreable_answer(text: Column) -> Column:
    """An answer without the lines that only name its sources."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^\s*(?:supporting\s+)?sources?\s*:.*$", ""), r"^\s+|\s+$", "")


def expected_type(question: Column) -> Column:
    """The kind of answer that a question asks for."""
    q = F.lower(spaced(question))
    return F.when(q.rlike(r"^when\b|\bwhat (date|day|month|year)\b"), "date").when(q.rlike(r"\bhow many\b|\bnumber of\b"), "count").when(q.rlike(r"^where\b|\bwhat (city|country|place)\b"), "place").when(q.rlike(r"^who\b"), "person").when(q.rlike(r"^(which|what) \w+s\b"), "list").when(q.rlike(r"^(is|are|was|were|do|does|did|has|have|can)\b"), "yes_no").otherwise("other")


def type_matches(kind: Column, answer: Column) -> Column:
    """Whether an answer has the form of its kind; anything but an empty text will do for other kinds."""
    a = F.lower(spaced(answer))
    months = r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
    return (
        F.when(a == "", False).when(kind == "date", a.rlike(rf"{months}|\b\d{{4}}\b|\b(today|yesterday|tomorrow|ago|last|week|month|year)\b"))
        .when(kind == "count", a.rlike(r"\d|\b(" + "|".join(list(NUMBERS)[2:]) + r"|once|twice|none|zero)\b")).when(kind == "list", a.rlike(r"[,;\n]| and "))
        .when(kind.isin("place", "person"), spaced(answer).rlike(r"\b[A-Z][a-z]+")).when(kind == "yes_no", a.rlike(r"^(yes|no)\b")).otherwise(True)
    )

