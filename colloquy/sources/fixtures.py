"""Deterministic views that give the dialogue tables' shapes on top of the provided tables, as SQL both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .staging import version_of, written_once

TABLES = ("conversations", "embeddings", "events", "lineitem")
VIEWS = {
    "fx_messages": "SELECT conv_id AS sample_id, CAST(turn AS INT) AS turn_index, role, text AS content, conv_id*1000+turn AS message_id, concat('D1:', turn+1) AS source_ref FROM conversations",
    "fx_queries": "SELECT m.sample_id, m.sample_id AS query_id, m.content AS question, m.turn_index AS query_turn FROM fx_messages m JOIN (SELECT sample_id, max(turn_index) AS lt FROM fx_messages GROUP BY sample_id) x ON m.sample_id=x.sample_id AND m.turn_index=x.lt WHERE m.role='user' AND m.turn_index>0",
    "fx_history": "SELECT m.* FROM fx_messages m JOIN fx_queries q ON m.sample_id=q.sample_id WHERE m.turn_index<q.query_turn AND m.role<>'system'",
    "fx_gold": "SELECT sample_id, sample_id AS query_id, message_id, source_ref FROM fx_history WHERE (sample_id*7+turn_index*3)%5<2",
    "fx_snapshots": "SELECT sample_id, message_id AS snapshot_id, message_id, source_ref, content, sample_id*100+CAST(floor((rn-1)/2) AS BIGINT) AS trajectory_id, (rn-1)%2+1 AS version FROM (SELECT h.*, row_number() OVER (PARTITION BY sample_id ORDER BY turn_index) AS rn FROM fx_history h) z",
    "fx_claims": "SELECT sample_id, trajectory_id, snapshot_id, snapshot_id*10+version AS claim_id, message_id AS source_message_id, source_ref, content AS text, CASE (snapshot_id%7) WHEN 0 THEN 'deprecated' WHEN 1 THEN 'contradictory' WHEN 2 THEN 'needs-confirmation' ELSE 'active' END AS status FROM fx_snapshots",
    "fx_page_members": "SELECT DISTINCT sample_id, sample_id*10 AS page_id, 'index' AS page_type, trajectory_id FROM fx_snapshots UNION ALL SELECT DISTINCT sample_id, sample_id*10+1+trajectory_id%2 AS page_id, 'topic' AS page_type, trajectory_id FROM fx_snapshots",
    "fx_ranked": "SELECT sample_id, sample_id AS query_id, trajectory_id, row_number() OVER (PARTITION BY sample_id ORDER BY (trajectory_id*13)%7, trajectory_id) AS rnk FROM (SELECT DISTINCT sample_id, trajectory_id FROM fx_snapshots) t",
    "fx_vectors": "SELECT label AS sample_id, vec_id AS snapshot_id, embedding, label*1000+CAST(floor((rn-1)/6) AS BIGINT) AS trajectory_id, (rn-1)%6+1 AS version FROM (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings e) z",
    "fx_calls": "SELECT event_id AS call_item_uid, CAST(floor(event_id/2) AS BIGINT) AS provider_call_uid, event_id%4 AS worker_id, CASE WHEN event_id%9=0 THEN NULL ELSE user_id%20 END AS sample_id, CASE WHEN event_id%9=0 THEN NULL ELSE user_id END AS query_id, CASE event_type WHEN 'signup' THEN 'episodic_extract' WHEN 'view' THEN 'wiki_page_rerank' WHEN 'click' THEN 'answer_generation' WHEN 'purchase' THEN 'benchmark_judge' ELSE 'answer_repair' END AS task, CASE event_type WHEN 'purchase' THEN 'judge' ELSE 'backbone' END AS role, CASE WHEN event_id%11=0 THEN NULL ELSE CAST(floor(value*10) AS BIGINT) END AS prompt_tokens, CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS completion_tokens, value AS latency_ms, ts FROM events",
    "fx_outcomes": "SELECT concat('v', l_linenumber) AS variant, l_orderkey AS query_id, min(l_suppkey) AS sample_id, min(l_returnflag) AS stratum, CASE min(l_partkey)%3 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'incorrect' END AS verdict, min(l_discount)*10 AS token_f1, CASE WHEN min(l_partkey)%13=0 THEN NULL ELSE min(l_tax)*10 END AS gold_ref_coverage, CAST(floor(min(l_quantity)*100) AS BIGINT) AS prompt_tokens FROM lineitem GROUP BY l_linenumber, l_orderkey",
    "fx_outcome_details": "SELECT o.*, round(token_f1*0.8+(query_id%5)*0.02, 6) AS bleu1, CASE WHEN query_id%7=0 THEN 1.0 ELSE 0.0 END AS abstained, CASE WHEN query_id%11=0 THEN NULL WHEN gold_ref_coverage>=0.4 THEN 1.0 ELSE 0.0 END AS source_supported, CASE WHEN verdict='incorrect' AND token_f1>0.3 THEN 1.0 ELSE 0.0 END AS unsupported_risk, CASE verdict WHEN 'correct' THEN CASE WHEN gold_ref_coverage>=0.4 THEN 1.0 ELSE 0.5 END WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END AS validated_judge FROM fx_outcomes o",
    "fx_phrases": "SELECT event_id AS message_id, user_id AS sample_id, concat(1+event_id%28, ' May, 2023') AS occurred_at, CASE event_id%8 WHEN 0 THEN concat('I went to a pottery workshop ', 2+event_id%5, ' days ago') WHEN 1 THEN 'I enjoy hiking, painting and chess' WHEN 2 THEN 'How many books did Anna read last year?' WHEN 3 THEN 'Thanks, bye!' WHEN 4 THEN 'My favorite color is green' WHEN 5 THEN concat('[D', 1+event_id%3, ':', event_id%20, '] Anna: I met Ben yesterday') WHEN 6 THEN 'Which cities have both Anna and Ben visited?' ELSE concat('VERDICT: ', CASE event_id%3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'PARTIAL' ELSE 'INCORRECT' END) END AS phrase FROM events",
    # what one retrieval of each query of fx_queries found, tier by tier
    "fx_page_ranks": "SELECT r.sample_id, r.query_id, p.page_id, row_number() OVER (PARTITION BY r.query_id ORDER BY min(r.rnk), p.page_id) AS rnk FROM fx_ranked r JOIN fx_page_members p ON r.trajectory_id=p.trajectory_id WHERE p.page_type='topic' GROUP BY r.sample_id, r.query_id, p.page_id",
    "fx_expanded": "SELECT r.sample_id, r.query_id, r.trajectory_id, s.snapshot_id, s.version, s.source_ref, s.content, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rnk, s.version) AS rnk FROM fx_ranked r JOIN fx_snapshots s ON r.trajectory_id=s.trajectory_id WHERE r.rnk<=2",
    "fx_event_items": "SELECT sample_id, query_id, 'page' AS tier, rnk, page_id AS item_id FROM fx_page_ranks WHERE rnk<=1 UNION ALL SELECT sample_id, query_id, 'trajectory', rnk, trajectory_id FROM fx_ranked WHERE rnk<=2 UNION ALL SELECT sample_id, query_id, 'expanded', rnk, snapshot_id FROM fx_expanded UNION ALL SELECT sample_id, query_id, 'source', row_number() OVER (PARTITION BY query_id ORDER BY rnk), snapshot_id FROM fx_expanded WHERE snapshot_id%3<>0",
    # an answer of each query: what it says, the references that it cites, and its verdict
    "fx_answers": "SELECT q.sample_id, q.query_id, q.question, g.gold_answer, CASE WHEN q.query_id%5=0 THEN 'Not enough information.' WHEN q.query_id%7=0 THEN '' ELSE a.answer_text END AS answer_text, CASE q.query_id%4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' ELSE 'judge_error' END AS verdict, CASE WHEN q.query_id%6=0 THEN 'unsupported_count' WHEN q.query_id%6=1 THEN 'format_repaired' END AS issue FROM fx_queries q LEFT JOIN (SELECT g.query_id, min_by(h.content, g.message_id) AS gold_answer FROM fx_gold g JOIN fx_history h ON g.message_id=h.message_id GROUP BY g.query_id) g ON q.query_id=g.query_id LEFT JOIN (SELECT query_id, min_by(content, rnk) AS answer_text FROM fx_expanded GROUP BY query_id) a ON q.query_id=a.query_id",
    "fx_support": "SELECT e.sample_id, e.query_id, m.source_ref, m.message_id, CASE WHEN e.item_id%10=4 THEN 'invalid' ELSE 'valid' END AS kind FROM fx_event_items e JOIN fx_messages m ON e.item_id=m.message_id WHERE e.tier='source' AND e.item_id%2=0",
    # English notes in chains of four, and the questions of the same samples
    "fx_notes": "SELECT sample_id, message_id, phrase, occurred_at, sample_id*100000+CAST(floor((rn-1)/4) AS BIGINT) AS trajectory_id, (rn-1)%4+1 AS version FROM (SELECT p.*, row_number() OVER (PARTITION BY sample_id ORDER BY message_id) AS rn FROM fx_phrases p WHERE message_id%8 IN (0,1,4,5)) z",
    "fx_note_claims": "SELECT sample_id, trajectory_id, version, message_id AS snapshot_id, message_id*10+1 AS claim_id, message_id AS source_message_id, CASE sample_id%2 WHEN 0 THEN 'Anna' ELSE 'Ben' END AS speaker, phrase AS source_text, occurred_at, replace(replace(phrase, 'My favorite', CASE message_id%3 WHEN 0 THEN 'Ben''s favorite' ELSE 'Anna''s favorite' END), 'I ', CASE message_id%5 WHEN 0 THEN 'The user ' ELSE 'Anna ' END) AS text, CASE message_id%7 WHEN 0 THEN 'deprecated' WHEN 1 THEN 'contradictory' WHEN 2 THEN 'needs-confirmation' ELSE 'active' END AS status FROM fx_notes",
    # what people found who judged some of the answers
    "fx_audit_labels": "SELECT sample_id, query_id, CASE query_id%3 WHEN 0 THEN true WHEN 1 THEN false END AS supported, CASE query_id%4 WHEN 0 THEN 'correct' WHEN 1 THEN 'trajectory_selection_miss' WHEN 2 THEN 'answer_synthesis_error' END AS stage, CASE WHEN query_id%5<3 THEN 20+query_id%50 END AS seconds, CASE query_id%4 WHEN 1 THEN true WHEN 2 THEN false END AS audit_correct, query_id%2=0 AS conflict_required, query_id%8<4 AS conflict_handled, query_id%3=0 AS obsolete_required, CASE query_id%6 WHEN 0 THEN true WHEN 3 THEN false END AS obsolete_handled FROM fx_queries",
    # a claim of an even message revises the claim of the version before
    "fx_claim_edges": "SELECT a.trajectory_id, a.claim_id, b.claim_id AS other_id FROM fx_note_claims a JOIN fx_note_claims b ON a.trajectory_id=b.trajectory_id AND a.version=b.version+1 WHERE a.claim_id%20=1",
    # a snapshot's own message and the one before it in its trajectory
    "fx_note_sources": "SELECT snapshot_id, source_message_id AS message_id, 1 AS position FROM fx_note_claims UNION ALL SELECT a.snapshot_id, b.source_message_id, 2 FROM fx_note_claims a JOIN fx_note_claims b ON a.trajectory_id=b.trajectory_id AND a.version=b.version+1",
    # calls with their model, variant, finish, fingerprint and origin
    "fx_rich_calls": "SELECT c.*, CASE WHEN role='judge' THEN 'Judge-1' WHEN worker_id=0 THEN 'small' WHEN worker_id=1 THEN 'SMALL' WHEN worker_id=2 THEN 'large' ELSE 'unknown' END AS model, concat('w', worker_id) AS variant, CASE completion_tokens%7 WHEN 0 THEN 'length' WHEN 1 THEN NULL ELSE 'stop' END AS finish, concat('fp', call_item_uid%3) AS fingerprint, CASE WHEN call_item_uid%10=0 THEN 'reused' ELSE 'new' END AS origin FROM fx_calls c",
    # English answers to the questions of the notes
    "fx_note_answers": "SELECT query_id, sample_id, question, CASE query_id%3 WHEN 0 THEN 'hiking, painting and chess' WHEN 1 THEN '3 books' ELSE 'green' END AS gold_answer, CASE query_id%5 WHEN 0 THEN 'painting; chess' WHEN 1 THEN 'At least 3 books, retrieved evidence confirms' WHEN 2 THEN 'hiking, painting, chess and pottery' WHEN 3 THEN 'green or blue' ELSE 'some activities' END AS answer_text, CASE query_id%4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'incorrect' END AS verdict FROM fx_asks",
    "fx_asks": "SELECT sample_id, message_id AS query_id, phrase AS question FROM fx_phrases WHERE message_id%8 IN (2,6)",
    # freely combined English sayings with their speakers, claims made of them, and each claim's sources: its own saying and the one before
    "fx_sayings": """SELECT event_id AS message_id, user_id AS sample_id, CASE event_id%4 WHEN 0 THEN 'Anna' WHEN 1 THEN 'Ben Carter' WHEN 2 THEN NULL ELSE 'Dora' END AS speaker, concat(CASE event_id%26 WHEN 0 THEN 'I play the guitar and my sister has a violin' WHEN 1 THEN 'I baked a chocolate cake with walnut cookies' WHEN 2 THEN 'My home country, Sweden, is cold in winter' WHEN 3 THEN 'I am reading "The Silent Patient" again' WHEN 4 THEN 'Anna and I went to New York last month' WHEN 5 THEN 'I researched adoption agencies last week' WHEN 6 THEN 'I am a single parent of two kids' WHEN 7 THEN 'As a transgender woman I gave a talk' WHEN 8 THEN 'We saw abstract art at the Museum of Modern Art' WHEN 9 THEN 'I joined a car modification workshop' WHEN 10 THEN 'I just returned from San Francisco yesterday' WHEN 11 THEN 'I enjoy hiking, painting and chess' WHEN 12 THEN 'My favorite dish is lemon pasta because it is quick' WHEN 13 THEN 'I signed up for a pottery class on Monday' WHEN 14 THEN 'Thanks, Ben Carter! Okay, see you soon' WHEN 15 THEN 'I painted a sunset with the rainbow flag' WHEN 16 THEN 'We visited the car show museum two years ago' WHEN 17 THEN 'We started a road trip three days ago and it was great' WHEN 18 THEN 'Our school event was a parade' WHEN 19 THEN 'I finished The Great Gatsby and read twice' WHEN 20 THEN 'I took the military aptitude test today' WHEN 21 THEN 'Running helps me destress' WHEN 22 THEN 'She likes It Ends With Us, of course' WHEN 23 THEN 'I moved to Lake Tahoe; Lake Tahoe is my favorite place' WHEN 24 THEN 'The books are Dune, Emma and Ulysses' WHEN 25 THEN 'Hey, it''s nothing, really' END, '. ', CASE (CAST(floor(event_id/26) AS BIGINT)*7+event_id)%26 WHEN 0 THEN 'I play the guitar and my sister has a violin' WHEN 1 THEN 'I baked a chocolate cake with walnut cookies' WHEN 2 THEN 'My home country, Sweden, is cold in winter' WHEN 3 THEN 'I am reading "The Silent Patient" again' WHEN 4 THEN 'Anna and I went to New York last month' WHEN 5 THEN 'I researched adoption agencies last week' WHEN 6 THEN 'I am a single parent of two kids' WHEN 7 THEN 'As a transgender woman I gave a talk' WHEN 8 THEN 'We saw abstract art at the Museum of Modern Art' WHEN 9 THEN 'I joined a car modification workshop' WHEN 10 THEN 'I just returned from San Francisco yesterday' WHEN 11 THEN 'I enjoy hiking, painting and chess' WHEN 12 THEN 'My favorite dish is lemon pasta because it is quick' WHEN 13 THEN 'I signed up for a pottery class on Monday' WHEN 14 THEN 'Thanks, Ben Carter! Okay, see you soon' WHEN 15 THEN 'I painted a sunset with the rainbow flag' WHEN 16 THEN 'We visited the car show museum two years ago' WHEN 17 THEN 'We started a road trip three days ago and it was great' WHEN 18 THEN 'Our school event was a parade' WHEN 19 THEN 'I finished The Great Gatsby and read twice' WHEN 20 THEN 'I took the military aptitude test today' WHEN 21 THEN 'Running helps me destress' WHEN 22 THEN 'She likes It Ends With Us, of course' WHEN 23 THEN 'I moved to Lake Tahoe; Lake Tahoe is my favorite place' WHEN 24 THEN 'The books are Dune, Emma and Ulysses' WHEN 25 THEN 'Hey, it''s nothing, really' END, '.') AS text FROM events""",
    "fx_saying_claims": "SELECT sample_id, message_id AS owner_id, CASE message_id%5 WHEN 0 THEN concat('The user said: ', text) WHEN 1 THEN concat('Anna said that ', text) WHEN 2 THEN replace(text, 'I ', 'Ben Carter''s friend ') ELSE text END AS text FROM fx_sayings",
    "fx_saying_sources": "SELECT message_id AS owner_id, 1 AS position, speaker, text FROM fx_sayings UNION ALL SELECT owner_id, 2, speaker, text FROM (SELECT lead(message_id) OVER (PARTITION BY sample_id ORDER BY message_id) AS owner_id, speaker, text FROM fx_sayings) z WHERE owner_id IS NOT NULL",
    # questions in payloads as chat services send them, some with images, some that only speak of them, some broken
    "fx_payloads": """SELECT query_id, concat('{"id": ', query_id, ', "messages": [{"role": "user", "content": "', question, '"}', CASE CAST(floor(query_id/8) AS BIGINT)%8 WHEN 0 THEN ', {"content": [{"type": "text"}, {"Type": "x", "parts": [{"image_url": null}]}]}' WHEN 1 THEN ', {"content": [[{"type": "IMAGE"}]]}' WHEN 2 THEN concat(', {"content": "say ', chr(92), '"image', chr(92), '": 1"}') WHEN 3 THEN ', {"content": "type image_url photo"}' WHEN 4 THEN ', {"note": {"deep": {"deeper": [1, {"photos": []}]}}}' WHEN 5 THEN ', {"type": ["image"]}' WHEN 6 THEN ', {broken' ELSE '' END, ']}') AS payload FROM fx_asks""",
    # what a model may write about an exchange, well-formed and not
    "fx_model_outputs": """SELECT event_id AS output_id, CASE event_id%10 WHEN 0 THEN concat('SUMMARY_CONTENT: a trip to the lake', chr(10), 'CONTEXT: chat', chr(10), 'KEYWORDS: lake, trip', chr(10), '[CLAIMS]', chr(10), '- status=active | source_message_ids=m1, m2 | text=Anna went to the lake', chr(10), '- status=confirmed | text=Ben = tall', chr(10), '[OPS]', chr(10), '- op=ADD | target_claim_id=tmp-c1 | rationale=new') WHEN 1 THEN concat('<think>', chr(10), 'SUMMARY_CONTENT of what', chr(10), '</think>', chr(10), 'Here it is', chr(10), 'SUMMARY_CONTENT: x', chr(10), 'CONTEXT: y: z', chr(10), 'KEYWORDS: none', chr(10), '[CLAIMS]', chr(10), '- status=Pending Confirmation | source_message_ids=none | text=maybe') WHEN 2 THEN concat('SUMMARY_CONTENT: only this', chr(10), 'no colon here', chr(10), '[CLAIMS]', chr(10), 'status=active | text=no bullet', chr(10), '- status=active | broken', chr(10), '- text=no status', chr(10), '- status=active') WHEN 3 THEN concat('NO_MEMORY') WHEN 4 THEN concat('KEYWORDS: a, b', chr(10), 'CONTEXT: c', chr(10), 'SUMMARY_CONTENT: d', chr(10), '[CLAIMS]', chr(10), '* status: active | text: mended claim', chr(10), '1) status=conflicted|text=numbered one', chr(10), 'plain words', chr(10), '[OPS]', chr(10), '• op: revise | target_claim_id: c7') WHEN 5 THEN concat('SUMMARY_CONTENT: s', chr(10), 'CONTEXT: c', chr(10), 'KEYWORDS: k', chr(10), '[CLAIMS]', chr(10), '- status=unsure | text=bad status', chr(10), '[OPS]', chr(10), '- op=NUKE | target_claim_id=c1', chr(10), '- op=DEPRECATE | rationale=no target', chr(10), '- target_claim_id=c2') WHEN 6 THEN concat('<think> never closed', chr(10), 'and on', chr(10), 'SUMMARY_CONTENT: ends it', chr(10), 'CONTEXT: c', chr(10), '', chr(10), 'KEYWORDS: k', chr(10), '[CLAIMS]', chr(10), '- <think>x</think>status=active | text=inline') WHEN 7 THEN '' WHEN 8 THEN CAST(NULL AS VARCHAR(9)) WHEN 9 THEN concat('CONTEXT: c', chr(10), '[DISPLAY_ITEMS]', chr(10), '- one', chr(10), '- two words', chr(10), 'three', chr(10), '[CLAIMS]', chr(10), '- status=active | text=last | text=wins') END AS text FROM events""",
}


_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r"|fx_\w+)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view over the tables of ``sf_dir``. Its temporary views have a prefix of their own."""
    own = lambda sql: _NAMES.sub(r"colloquy_\1", sql)
    needs = _needs(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", needs):
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(own(t))
    for v in _chain(name):
        spark.sql(own(VIEWS[v])).createOrReplaceTempView(own(v))
    return spark.table(own(name))


class Views:
    """The fixture views of a folder by name, and tables over them that are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._version = spark, sf_dir.rstrip("/"), None

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        """A view that many queries read, written once."""
        return self.once(name, lambda: self(name))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written once for these inputs under ``name``."""
        if self._version is None:
            self._version = version_of(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in TABLES])
        return written_once(self.spark, self._version, name, make)


def _chain(name: str) -> list[str]:
    """The view and those that it reads, in order."""
    used = re.findall(r"\bfx_\w+", VIEWS[name])
    below = [x for v in VIEWS if v in used for x in _chain(v)]
    return [*dict.fromkeys(below), name]


def _needs(name: str) -> str:
    return " ".join(VIEWS[v] for v in _chain(name))


def with_views(sql: str) -> str:
    """``sql`` behind the common table expressions of the views that it names."""
    used = dict.fromkeys(x for v in VIEWS if v in sql for x in _chain(v))
    ctes = [f"{v} AS ({VIEWS[v]})" for v in used]
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().upper().startswith(head):
            return head + ", ".join(ctes) + ", " + sql.lstrip()[len(head) :]
    return "WITH " + ", ".join(ctes) + " " + sql
