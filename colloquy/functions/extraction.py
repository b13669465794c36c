"""Rules of what a text says, as rows, and column functions that clean what they find.

A rule is a row: ``literals`` (lower case; one of them must occur for the pattern to be tried, none means always), ``pattern``
(its first group, or the whole, is the value; null: the literals themselves as whole words), ``value`` (what is said
instead, if the rule fixes it), ``folded`` (look in the lower-cased text), ``first`` (only the first match counts).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import keywords

RULE = "rule_id string, place int, family string, category string, relation string, literals array<string>, pattern string, value string, folded boolean, first boolean, clean string"

# Words and patterns that the results depend on.
INSTRUMENTS = "bass|cello|clarinet|drums|flute|guitar|harp|piano|saxophone|trumpet|ukulele|viola|violin".split("|")
SYMBOLS = "heart|lotus|moon|peace sign|rainbow|rainbow flag|star|sun|tree of life".split("|")
FOODS = "cake|cakes|cookie|cookies|pie|pies|bread|pasta|pizza|soup|salad|curry|stew|lasagna|muffin|muffins|brownie|brownies|sandwich|sandwiches|taco|tacos".split("|")
NOISE = "ah anything anyway cool definitely hello hey hi hmm just nope okay ok really right sure thanks thank welcome well yeah yep".split()
PRONOUNS = "he her hers him his i it its me mine my myself our ours she their theirs them they us we you your yours".split()
CALENDAR = "april august december february friday january july june march monday november october saturday september sunday thursday tuesday wednesday".split()
VAGUE = "afternoon day days evening later morning night recently soon time times today tomorrow tonight week weeks yesterday".split()
OPENERS = "actually amazing any because before being great more most next some".split()
STOP_SPANS = "A An And Are As At Because Been Before Being Between But By Could Did Do Does During For From Had Has Have How If In Into Is It Its Last More Most My Next Of On Or Our Really Should Since That The Their There These This Those To We Were What When Where Which While Who Why With Would You Your".split()
STOP_ITEMS = "a an and anything everything friday it monday nothing or saturday she something stuff sunday that the them these things this those thursday tuesday wednesday what yeah".split()
TRUSTED = "food_suffix home_country instrument place quoted symbol".split()
SPAN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
TITLE = r"\b(?:[A-Z][A-Za-z0-9'’-]*(?::[A-Z][A-Za-z0-9'’-]*)?)(?:\s+(?:[A-Z][A-Za-z0-9'’-]*(?::[A-Z][A-Za-z0-9'’-]*)?|of|the|and|a|an|to|with|for|in|on|at))*\b"
QUOTED = r"[\"“](.{2,80}?)[\"”]"
LOCATION = r"\b(?:in|from)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
COUNTRY = r"(?i)\bhome country[, ]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9\-']+"
_ACROSS = r"[a-zA-Z][a-zA-Z0-9'’\-\s]"
_MANY = r"(?:\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)"
_SPAN_OF_TIME = r"(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekend|week|month|year|night|summer|winter|spring|fall|autumn)"
TEMPORAL = (
    r"(?i)\b(yesterday|today|tomorrow|recently|last\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|weekend|month|year|night|summer|winter|spring|fall|autumn)"
    r"|this\s+past\s+weekend|this\s+(?:week|weekend|month|year|summer|winter|spring|fall|autumn)|next\s+(?:week|weekend|month|year)"
    rf"|(?:about|around)\s+{_MANY}\s+years?\s+ago|a\s+few\s+years?\s+ago|{_MANY}\s+(?:days?|weeks?|months?|years?)\s+ago)\b"
)
TRAILING = (
    rf"(?i)\b(?:last|this|next)\s+{_SPAN_OF_TIME}\b.*$|\b(?:yesterday|today|tomorrow|recently|lately)\b.*$|\b(?:about|around)\s+{_MANY}\s+years?\s+ago\b.*$"
    rf"|\ba\s+few\s+years?\s+ago\b.*$|\b{_MANY}\s+(?:days?|weeks?|months?|years?)\s+ago\b.*$"
    r"|\s+(?:with|for|because|but|so|when|while|after|before|which|who|that|where|if|though)\b.*$"
)
CLAUSE = r"(?i)\b(?:because|but|so|when|while|after|before|which|who|that|where|if|though)\b.*$"
LEADERS = [
    r"(?i)^.*\b(?:include|includes|included|are|were|is|was|involve|involves)\b\s+",
    r"(?i)^.*\b(?:enjoys?|likes?|loves?|does|plays?|practices?|participates?\s+in|partakes?\s+in)\b\s+",
    r"(?i)^(?:and|or|also|including|such as)\s+", r"(?i)\s+(?:and|or)$",
]
#: What a memory must keep: (rule, category, relation, literals, pattern, how it is cleaned).
KEEP = [
    ("research_topic_pattern", "research_topic", "research_topic", "research", rf"(?i)\bresearch(?:ed|es|ing)?\s+(?:about\s+|on\s+|into\s+)?({_ACROSS}{{2,80}})", "topic"),
    ("preference_excitement_pattern", "preference_item", "preference_item", "stoked|excited", r"(?i)\b(?:stoked|excited)\s+(?:about|for)\s+([^.!?]+)", "clause7"),
    ("preference_verb_pattern", "preference_item", "preference_item", "love|like|enjoy|prefer", r"(?i)\b(?:love|loved|like|liked|likes|enjoy|enjoyed|enjoys|prefer|preferred|prefers)\s+([^.!?]+)", "clause7"),
    ("favorite_value_pattern", "preference_item", "preference_item", "favorite|favourite", r"(?i)\bfavo(?:u)?rite\s+[a-zA-Z][a-zA-Z0-9'’\-\s]{0,40}?\s+(?:is|was|are|were|:)\s*(?:a|an|the)?\s*([a-zA-Z][a-zA-Z0-9'’\-\s]{2,70})", "clause7"),
    ("painted_object_action_pattern", "painted_object", None, "paint|drew|drawn|sketched", r"(?i)\b(?:painted|paint|drew|drawn|sketched)\b(?:\s+(?:a|an|the|this|that|my|our|another))?\s+([a-zA-Z][a-zA-Z0-9'’\-\s]{2,70})", "surface6"),
    ("picture_of_object_pattern", "painted_object", None, "painting|picture|image|drawing|artwork|sketch", r"(?i)\b(?:painting|picture|image|drawing|artwork|sketch)\s+(?:of|with)\s+(?:a|an|the|this|that|my|our)?\s*([a-zA-Z][a-zA-Z0-9'’\-\s]{2,70})", "surface6"),
    ("favorite_food_pattern", "food", None, "favorite|favourite", r"(?i)\bfavo(?:u)?rite\s+(?:food|dish|snack|dessert|meal|recipe)\s+(?:is|was|are|were|:)?\s*(?:a|an|the)?\s*([a-zA-Z][a-zA-Z0-9'’\-\s]{2,70})", "surface6"),
    ("registered_activity_pattern", "activity", "activity", "signed|signing|registered|enrolled", r"(?i)\b(?:signed\s+up|signing\s+up|registered|enrolled)\s+for\s+(?:a|an|the)?\s*([A-Za-z][A-Za-z0-9'’\-\s]{2,70}?\b(?:class|course|workshop|lesson))\b", "surface6"),
    ("activity_purpose_pattern", "activity", "activity", "pottery|running|reading|violin|hiking|camping|swimming|painting", r"(?i)\b(pottery(?:\s+class)?|running|reading|playing\s+(?:my\s+|the\s+)?violin|violin|hiking|camping|swimming|painting)\b[^.!?]{0,120}\b(?:destress|de-stress|clear\s+my\s+mind|headspace|refresh(?:es)?\s+me|therapy\s+for\s+me|express\s+myself|get\s+creative|reset|recharge)\b", "surface6"),
    ("activity_action_temporal_pattern", "activity", "activity", "lift|weight|working|exercising", r"(?i)\b(?:start(?:ed|ing)?|began|begin(?:ning)?|try(?:ing|ied)?|practice(?:d|s|ing)?)\s+(?:to\s+)?(lift(?:ing)?\s+weights?|weight\s+lifting|weightlifting|working\s+out|exercising)\b", "timed6"),
    ("book_title_action_pattern", "book_title", None, "read|finished|started", r"\b(?:[Rr]ead|[Rr]eading|[Ff]inished|[Ss]tarted)\s+(?:the\s+book\s+)?(?:called|titled)?\s*([A-Z][A-Za-z0-9'’:\-\s]{2,80}|[\"“][^\"”]{2,80}[\"”])", "title8"),
    ("test_type_action_pattern", "test_type", "test_type", "test", r"(?i)\b(?:take|takes|taking|took|taken|retake|retakes|retaking|retook|retaken|completed|sat|sitting|passed|failed)\s+((?:the\s+)?[A-Za-z][A-Za-z0-9'’\-\s]{2,80}?\btest)\b", "title8"),
    ("named_test_pattern", "test_type", "test_type", "test", r"(?i)\b((?:the\s+)?(?:military\s+)?aptitude\s+test)\b", "title8"),
    ("place_action_pattern", "place", None, "went|go|travel|moved|camped|visited|returned", r"(?i)\b(?:went|go|traveled|travelled|moved|camped|visited|returned)\s+(?:to|in|at|from)\s+(?:a|an|the)?\s*([A-Za-z][A-Za-z0-9'’\-\s]{2,70})", "surface6"),
    ("instrument_action_pattern", "instrument", None, "play|learn|practic", r"(?i)\b(?:plays?|played|learned|learning|practices?|practiced)\s+(?:the\s+)?([a-zA-Z][a-zA-Z0-9'’\-\s]{2,50})", "surface6"),
    ("networking_event_action_pattern", "event_object", "event_object", "networking", r"(?i)\b(?:went|go|visited|attended|chose\s+to\s+go)\s+to\s+(networking\s+events?)\b", "event8"),
    ("event_object_action_pattern", "event_object", "event_object", "competition|contest|event|race|campaign|conference|workshop|program|speech|talk|road|meeting|parade|museum|exhibit|fair|convention", r"(?i)\b(?:host(?:ed|ing)?|attend(?:ed|ing)?|visit(?:ed|ing)?|went|go|chose\s+to\s+go|launch(?:ed|ing)?|start(?:ed|ing)?|join(?:ed|ing)?|participat(?:ed|ing)|run(?:ning)?|gave|give|giving)\b(?:\s+(?:a|an|the|my|our))?(?:\s+(?:to|in|at|for|with|on))?\s+([A-Za-z][A-Za-z0-9'’\-\s]{1,80}?\b(?:competition|contest|events?|race|campaign|conference|workshop|program|speech|talk|roadtrip|road\s+trip|meeting|parade|museum|exhibit|fair|convention))\b", "event8"),
    ("roadtrip_temporal_pattern", "event_object", "event_object", "road", r"(?i)\b(?:road\s*trip|roadtrip)\b([^.!?]{0,100})", "roadtrip"),
    ("car_accident_visual_or_text_pattern", "event_object", "event_object", "car|flatbed|tow", r"(?i)\b((?:damaged|crashed|wrecked)\s+car|car\s+(?:accident|crash|wreck)|flatbed|tow(?:ed|ing)?\s+truck)\b", "accident"),
    ("event_phrase_pattern", "event_type", "event_type", "school|mentor|workshop|program", r"(?i)\b(school\s+speech|school\s+talk|mentorship\s+program|mentoring\s+program|mentor\s+program|[a-zA-Z][a-zA-Z'\-]+\s+workshop|[a-zA-Z][a-zA-Z'\-]+\s+program)\b", "timed"),
    ("school_event_pattern", "event_type", "event_type", "school", r"(?i)\bschool\s+event\b", "school"),
    ("school_speech_signal", "signal", None, "talk|giving|gave|speech|shared|encouraged", r"(?i)\b(talk(?:ed|ing)?|giving\s+(?:my\s+|her\s+|his\s+|their\s+)?talk|gave\s+(?:a\s+)?talk|speech|shared\s+(?:my|her|his|their)\s+(?:own\s+)?journey|encouraged\s+students)\b", "signal"),
    ("count_cue_pattern", "count", None, "0|1|2|3|4|5|6|7|8|9|one|two|three|four|five|six|seven|eight|nine|ten|once|twice", r"(?i)\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|once|twice)\b(?:\s+(?:times?|books?|recipes?|dishes?|dogs?|kids?|children|events?|activities|places|cities|wins?|medals?))?", "count"),
    ("inventory", "list", None, "activit|hobbies|interest|item|thing|book|recipe|dish|instrument|symbol", r"(?i)\b(?:activities?|hobbies|interests?|items?|things?|books?|recipes?|dishes?|instruments?|symbols?)\b[^.!?]{0,80}?\b(?:include|includes|included|are|were|is|was|involve|involves)\b\s+([^.!?]+)", "list40"),
    ("activity_verbs", "list", None, "enjoy|like|love|does|play|practice|participate|partake", r"(?i)\b(?:enjoys?|likes?|loves?|does|plays?|practices?|participates?\s+in|partakes?\s+in)\b\s+([^.!?]+)", "list40"),
    ("comma_list", "list", None, ",", r"[^.!?]*,[^.!?]*,[^.!?]*", "list0"),
]
#: The kind of a list by the words around it, the first that fits.
LIST_KINDS = [
    ("activity", "activit|enjoys|likes|loves|partakes|participates|practices"), ("book_title", "book"), ("recipe", "recipe|dish"), ("instrument", "instrument|play"), ("symbol", "symbol"),
    ("place", "city|cities|place|places|visited|travel|camped|camping"), ("event_type", "event|workshop|program|speech|parade|group"), ("painted_object", "paint"),
]
#: Facets: (rule, relation, value or None for the group, type, confidence, literals, pattern, first).
FACETS = [
    ("single_parent", "relationship_status", "single", "identity_status", 0.98, "single parent", r"(?i)single parent", True),
    ("transgender_woman", "gender_identity", "transgender woman", "identity_status", 0.99, "transgender woman", r"(?i)transgender woman", True),
    ("home_country", "home_country", None, "origin", 0.97, "home country", COUNTRY, True),
    ("adoption_agencies", "research_topic", "adoption agencies", "topic", 0.96, "adoption agenc", r"(?is)research.*adoption agenc|adoption agenc.*research", True),
    ("abstract_art", "art_style", "abstract art", "creative_style", 0.98, "abstract art", r"(?i)abstract art", True),
    ("car_modification", "event_type", "car modification workshop", "event", 0.96, "car modification workshop", r"(?i)car modification workshop", True),
    ("san_francisco", "activity_location", None, "location", 0.95, "san francisco", r"(?i)\b(?:returned from|in)\s+(San Francisco)\b", False),
]


def term_rules() -> list[tuple]:
    """The rules of exact terms: known instruments, symbols and foods, quoted and capitalised spans, places."""
    known = [(f"{kind}:{w}", kind, [w], rf"\b{re.escape(w)}\b", w, True, True) for kind, words in (("instrument", INSTRUMENTS), ("symbol", SYMBOLS)) for w in words]
    foods = [(f"food_suffix:{w}", "food_suffix", [w], rf"\b(?:[a-z]+(?:-[a-z]+)?\s+){{0,3}}{w}\b", None, True, False) for w in FOODS]
    spans = [("quoted", "quoted", ['"', "“"], QUOTED, None, False, False), ("title_case", "title_case", [], TITLE, None, False, False), ("place", "place", ["in", "from"], LOCATION, None, False, True), ("home_country", "home_country", ["home country"], COUNTRY, None, False, True)]
    return [(r, n, "term", kind, None, lits, pattern, value, folded, first, "term") for n, (r, kind, lits, pattern, value, folded, first) in enumerate([*known, *foods, *spans])]


def facet_rules() -> list[tuple]:
    return [(r, n, "facet", kind, relation, lits.split("|"), pattern, value, False, first, str(sure)) for n, (r, relation, value, kind, sure, lits, pattern, first) in enumerate(FACETS)]


def keep_rules() -> list[tuple]:
    return [(r, n, "keep", category, relation, lits.split("|"), pattern, None, False, how in ("roadtrip", "accident", "school", "signal"), how) for n, (r, category, relation, lits, pattern, how) in enumerate(KEEP)]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def collapsed(c: Column | str) -> Column:
    """One space for every stretch of white space, none around."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _words(*lists: list[str]) -> Column:
    return F.array(*(F.lit(w.lower()) for x in lists for w in x))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _meaningful(c: Column) -> Column:
    return F.size(F.array_except(keywords(c), _words(NOISE, PRONOUNS, CALENDAR, VAGUE, OPENERS, STOP_SPANS))) > 0


def stop_span(c: Column) -> Column:
    """A capitalised span that names nothing: one of its words is a stop word, noise, a pronoun, a day or a month."""
    words = F.split(collapsed(c), " ")
    bad = F.arrays_overlap(words, F.array(*map(F.lit, STOP_SPANS))) | F.arrays_overlap(F.transform(words, F.lower), _words(NOISE, PRONOUNS, CALENDAR, OPENERS))
    return bad | c.rlike("['’]") | ((F.size(words) == 1) & (F.length(words[0]) < 3))


def low_value(c: Column) -> Column:
    t = tokens(c)
    single = (F.size(t) == 1) & F.arrays_overlap(t, _words(NOISE, PRONOUNS, CALENDAR, VAGUE, OPENERS, STOP_SPANS))
    return (F.size(t) == 0) | single | F.exists(t, lambda w: w.contains("'")) | ~_meaningful(c)


def place_like(c: Column) -> Column:
    t = tokens(c)
    return ~stop_span(c) & (F.size(t) > 0) & ~F.arrays_overlap(t, _words(NOISE, PRONOUNS, CALENDAR, VAGUE)) & _meaningful(c)


def term_fault(c: Column, kind: Column, speakers: Column) -> Column:
    """Why a term is discarded, null for one that is kept. ``speakers`` are lower-cased names."""
    t, trusted = tokens(c), kind.isin(TRUSTED)
    return (
        F.when((kind == "title_case") & (stop_span(c) | (c == "")), "stop_span").when(F.size(t) == 0, "no_word").when(F.array_contains(speakers, F.lower(c)), "speaker")
        .when(F.arrays_overlap(t, _words(PRONOUNS, NOISE)), "pronoun_or_noise").when(F.arrays_overlap(t, _words(CALENDAR, VAGUE)), "calendar_or_vague")
        .when(F.exists(t, lambda w: w.contains("'")), "apostrophe").when(~trusted & low_value(c), "low_value").when(~trusted & (F.size(t) == 1) & c.rlike("^[A-Z]"), "single_title_word")
    )


def entity_fault(c: Column, speakers: Column) -> Column:
    """True for an entity mention that is none; a speaker's name always is one."""
    t = tokens(c)
    one = (F.size(t) == 1) & ((F.length(t[0]) < 3) | F.arrays_overlap(t, _words(OPENERS)))
    return ~F.array_contains(speakers, F.lower(c)) & (stop_span(c) | (F.size(t) == 0) | F.arrays_overlap(t, _words(PRONOUNS, NOISE, CALENDAR, VAGUE)) | one)


_EDGE = " -:,.!?\"'“”‘’"
_TRAILING, _CLAUSE, _LEADERS = re.compile(TRAILING, re.S), re.compile(CLAUSE, re.S), [re.compile(p, re.S) for p in LEADERS]
_ARTICLE, _JOIN, _PIECES = re.compile(r"(?i)^(?:a|an|the|this|that|my|our|another)\s+"), re.compile(r"(?i)\s+\b(?:and|but|while|because|so)\b\s+"), re.compile(r"(?i)\s*(?:,|;|\band\b|\bor\b)\s+")
_KINDS = [(name, re.compile(words)) for name, words in LIST_KINDS]


def clean_item(value: str) -> str | None:
    """A list item without its lead-in, trailing clause and joining words; None if it says nothing."""
    x = _CLAUSE.sub("", " ".join(value.strip(_EDGE).split())).strip(" -:,.!?")
    for lead in _LEADERS:
        x = lead.sub("", x)
    x = " ".join(x.split())
    words = re.findall(r"[a-z0-9][a-z0-9'\-]*", x.lower())
    return x if 0 < len(words) <= 5 and set(words) - set(STOP_ITEMS) and len(x) >= 3 else None


def clean_surface(value: str, most: int, article: bool = False) -> str | None:
    """A phrase without the time or clause behind it, and without its article unless ``article``."""
    x = _TRAILING.sub("", " ".join(value.strip(_EDGE).split())).strip(_EDGE)
    x = clean_item(x if article else _ARTICLE.sub("", x))
    return x if x and len(re.findall(r"[a-zA-Z0-9][a-zA-Z0-9'’\-]*", x)) <= most else None


def surfaces(how: str, value: str, span: str, start: int, text: str) -> list[tuple[str, str | None]]:
    """(surface, kind) of what a rule found, cleaned as the rule says; several for a list of two items or more."""
    if how in ("list0", "list40"):
        around = (text[max(0, start - 40) : start + len(span) + 40] if how == "list40" else span).lower()
        kind = next((name for name, words in _KINDS if words.search(around)), "list_item")
        items = [x for x in map(clean_item, _PIECES.split(value)) if x]
        return [(x, kind) for x in items] if len(items) > 1 else []
    fixed = {"roadtrip": "roadtrip", "accident": "car accident", "school": "school event"}
    if how in fixed:
        return [(fixed[how], None)]
    if how == "topic":
        out = clean_item(_JOIN.split(value, maxsplit=1)[0])
    elif how == "clause7":
        out = clean_surface(_JOIN.split(value, maxsplit=1)[0], 7)
    elif how[-1].isdigit() and how[:-1] in ("surface", "timed", "title", "event"):
        out = clean_surface(value, int(how[-1]), how.startswith("title"))
    else:
        out = " ".join(value.split())
    return [(out, None)] if out else []
