"""Model outputs against a plain parser that walks over the lines."""

import random
import re
from collections import Counter

from colloquy.operators import outputs as O


def walked(text):
    """(line, kind, section, key, value, reason, repaired) by a loop that keeps its state."""
    out, thinking, seen, section, have = [], False, False, None, set()
    text = text or ""
    for n, raw in enumerate(re.split(r"\r?\n", text), 1):
        said = re.sub(r"(?i)<think\b[^>]*>.*?</think>", "", raw).rstrip(" ")
        low = said.strip(" ").lower()
        begins = bool(re.search(r"^\s*\[.*\]\s*$", said) or re.search(r"^\s*[A-Z][A-Z0-9_ ]*\s*:", said))
        closing = "</think>" in low
        if closing:
            thinking = False
        elif low.startswith("<think"):
            thinking = True
        elif begins:
            thinking = False
        hidden = thinking or closing
        seen = seen or (begins and not hidden)
        if text.strip(" ") == "NO_MEMORY":
            out.append((n, "skipped", None, None, raw, "no_memory", False))
            continue
        if low == "" or hidden or not seen:
            out.append((n, "skipped", section, None, raw, "blank" if low == "" else "reasoning" if hidden else "preamble", False))
            continue
        if re.fullmatch(r"\[.*\]", said):
            section = said[1:-1]
            out.append((n, "header", section, None, raw, None, False))
        elif section is None:
            if ":" in said:
                key, value = said.split(":", 1)
                have.add(key.strip(" "))
                out.append((n, "field", None, key.strip(" "), value.strip(" "), None, False))
            else:
                out.append((n, "reject", None, None, raw, "malformed_top_field", False))
        elif section in ("CLAIMS", "OPS"):
            parts = said[2:].split(" | ") if said.startswith("- ") else None
            mended = parts is None or any("=" not in p for p in parts)
            if mended:
                parts = [p if "=" in p else re.sub(r"^([A-Za-z_]+)\s*:\s*", r"\1=", p) for p in re.split(r"\s*\|\s*", re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", said))]
            if any("=" not in p for p in parts):
                out.append((n, "reject", section, None, raw, "malformed_pipe_record" if said.startswith("- ") else "malformed_list_record", False))
                continue
            record = {p.split("=", 1)[0].strip(" "): p.split("=", 1)[1].strip(" ") for p in parts}
            need = ("status", "text") if section == "CLAIMS" else ("op", "target_claim_id")
            lost = next((k for k in need if k not in record), None)
            status = O.ALIASES.get(record.get("status", "").lower(), record.get("status", "").lower())
            bad = f"missing_record_key:{lost}" if lost else "invalid_claim_status" if section == "CLAIMS" and status not in O.STATUSES else "invalid_op_type" if section == "OPS" and record["op"].upper() not in O.OPS else None
            if bad:
                out.append((n, "reject", section, None, raw, bad, False))
            else:
                out.append((n, "claim" if section == "CLAIMS" else "op", section, None, record["text"] if section == "CLAIMS" else record.get("rationale", "none given"), None, mended))
        elif said.startswith("- "):
            out.append((n, "item", section, None, said[2:].strip(" "), None, False))
        else:
            out.append((n, "reject", section, None, raw, "malformed_list_record", False))
    if text.strip(" ") != "NO_MEMORY":
        out += [(0, "reject", None, k, None, "missing_field", False) for k in O.REQUIRED if k not in have]
    return out


LINES = [
    "SUMMARY_CONTENT: a: b", "CONTEXT:", "KEYWORDS: x, y", "OTHER KEY 2 : v", "[CLAIMS]", "[OPS]", "[ITEMS]", " [CLAIMS] ", "- status=active | text=plain", "- status=Confirmed | source_message_ids=m1,m2 | text=a=b", "* status: active | text: mended",
    "2. status=deprecated|text=tight", "- status=odd | text=x", "- text=only", "- status=active", "- op=add | target_claim_id=c", "- op=REVISE | target_claim_id=c | rationale=why", "- op=X | target_claim_id=c", "• op: ADD | target_claim_id: 9", "plain words", "- item",
    "", "   ", "<think>", "</think>", "thought </think>", "<THINK a=b>inline</think>- status=active | text=after", "<think> open", "lower: case", "- status=active | text=one | text=two", "NO_MEMORY", "- a=b |c", "trailing  ",
]


def test_every_line_has_its_row(spark):
    rng = random.Random(6)
    texts = [None, "", "NO_MEMORY", " NO_MEMORY ", "NO_MEMORY\n", "a\r\nSUMMARY_CONTENT: x\r\n[CLAIMS]\r\n- status=active | text=t"]
    texts += [rng.choice(["\n", "\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(10**6, texts[7]), (10**6, texts[8])]  # one id, two outputs
    rows = [(i, t, "k", 1) for i, t in rows]
    got = O.parsed_outputs(spark.createDataFrame(rows, "output_id long, text string, kind string, line int"))
    want = Counter((i, *r) for i, t, *_ in rows for r in walked(t))
    mine = Counter((r.output_id, r.line, r.kind, r.section if r.reason != "no_memory" else None, r.key, r.value, r.reason, r.repaired) for r in got.collect())
    assert mine == want
    assert sum(n for r, n in mine.items() if r[1]) == sum(len(re.split(r"\r?\n", t or "")) for _, t, *_ in rows)
    assert O.parsed_outputs(spark.createDataFrame([], "output_id long, text string")).count() == 0
