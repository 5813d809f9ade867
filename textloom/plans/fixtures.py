"""Small nested tables that the driver has not: profiles, personas, evidence, posts and a published history, written for the queries."""

from __future__ import annotations

from textloom.operators.persona import PERSONA as PERSONA_DDL  # noqa: F401
from textloom.operators.profiles import PROFILE as PROFILE_DDL  # noqa: F401

# --- profiles: a sound one and what may be wrong with it
_ABOUT = """Month end takes ten days where nobody owns the ledger. My close map names an owner for each step.

"""
_ABOUT += "A controller in Leeds cut 26 hours from each close. A clinic group now books 4,300 receipts a week without overtime. " * 4
_ABOUT += "\n\nThe close map works because the team keeps it. Send me a note and I will share the sheet."
_ROLES = [
    {"title": "Finance operations lead", "company": "Harrow & Pike", "period": "2021 - present", "bullets": ["Cut 26 hours from the close", "Moved 14 entities to one ledger"]},
    {"title": "Controller", "company": "Tarn Clinics", "period": "2017 - 2021", "bullets": ["Booked 4,300 receipts a week", "Closed 48 months in a row on day 5"]},
    {"title": "Accountant", "company": "Oak Freight", "start": "2013", "end": "2017", "description": "Kept the books of three depots and trained 11 clerks."},
]
SOUND = {
    "id": "sound", "custom_url_slug": "mira-voss", "headline": "Finance operations lead for month end close | 26 hours back per close", "about": _ABOUT, "experience": _ROLES,
    "featured": [{"title": "Close map", "kind": "offer", "url": "https://example.org/map", "description": "The sheet"}, {"title": "Case study: Tarn", "kind": "case", "url": "https://example.org/tarn", "description": "From day 12 to day 5"}] + [{"title": f"Note {i}", "kind": "post", "url": f"https://example.org/{i}", "description": "A note"} for i in range(3)],
    "education": [{"school": "Leeds", "field": "Accounting", "year": 2012}], "licenses": [], "skills": ["Month end close", "Reconciliation", "Ledgers"], "contact": {"email": "mira@example.org"},
}
PROFILES = [
    SOUND,
    SOUND | {"id": "thin", "about": _ABOUT[:180]},
    SOUND | {"id": "echo", "about": SOUND["headline"]},
    SOUND | {"id": "reversed", "experience": _ROLES[::-1]},
    SOUND | {"id": "login", "headline": "Sign in to see more", "about": "", "experience": [], "skills": [], "featured": None},
    SOUND | {"id": "template", "about": _ABOUT + " Lorem ipsum dolor.", "contact": {"email": "", "phone": None}},
    SOUND | {"id": "firm", "headline": "A consulting firm for month end close", "featured": [{"title": "", "kind": "", "url": "", "description": ""}], "publicIdentifier": "20193344"},
    SOUND | {"id": "plain", "headline": "Bookkeeper", "about": "In 2019 I began. I like numbers, but 2020 was hard. " * 12, "experience": [{"title": "Clerk", "company": "Oak Freight", "period": "2019"}], "custom_url_slug": "12345", "skills": None, "education": None, "featured": [], "contact": None},
]
SETTINGS = {
    "role_titles": ["finance operations lead", "controller"], "primary_keyword": "month end close", "secondary_keywords": ["close map", "ledger"], "problem": "nobody owns the ledger", "method": "close map", "differentiator": "the team keeps it", "slug": None, "banner": "b.png", "photo": "p.png",
    "proof": [{"claim": "c", "tier": "measured", "source": "log", "permission": "granted"}], "require_permission": True, "paid_offers": [{"name": "Close map", "outcome": "o", "price_model": "fixed", "featured_slot": 1}], "destinations": ["https://example.org"],
    "forbid": ["thoughts?"], "avoid": ["consulting firm"], "promises": ["An owner for each step", "A ledger without overtime"],
    "sample_style": {"mean_sentence_words": 10.0, "length_variance": 0.4, "paragraphs": 3.0, "exclamations": 0.0, "questions": 0.0, "commas": 4.0, "dashes": 0.0, "contractions": 0.0, "hashtags": 0.0, "numbers": 12.0, "emoji": 0.0},
}

# --- personas
_FULL = {
    "persona_id": "full", "profile": {"display_name": "Mira", "role_title": "lead", "domain": "finance-ops", "timezone": "Europe/London"}, "positioning": {"statement": "s", "problem": "p", "method": "The 12 Step Close", "differentiator": "d"}, "publish": {"mode": "auto", "approval_required": True}, "primary_keyword": "close 365", "require_permission": True,
    "proof": [{"id": f"h{i}", "tier": "measured", "claim": f"claim {i}", "source": "log", "permission": "granted"} for i in range(4)], "assets": [{"id": "a1", "proof_refs": ["h1", "a1"]}],
    "beliefs": [{"id": f"b{i}", "claim": "c", "confidence": "high", "evidence_refs": ["h0"]} for i in range(3)], "hot_takes": [{"id": "t1", "evidence_refs": ["h3"]}],
    "pillars": [{"id": "p1", "promise": "x", "weight": 0.6, "maps_to_beliefs": ["b0", "b1"]}, {"id": "p2", "promise": "x", "weight": 0.4, "maps_to_beliefs": []}], "segments": [{"id": "s1"}], "primary_segment": "s1", "ladder": [{"rung": 1, "id": "l1", "cta_text": "Send a note", "serves": ["p1"]}],
    "paid_offers": [{"name": "map", "outcome": "o", "price_model": "m", "proof_refs": ["h2"]}], "voice": {"target_words": 9.0, "min_length_variance": 0.2, "emoji": False},
    "samples": ["Name an owner for each step. Then close the month in five days, with one sheet and no meeting. #close", "Ask who owns the ledger. If nobody answers, you have found the reason for day twelve. #ledger", "Write the step down. Read it to the clerk who does it, and change what they do not know. #steps"],
}
PERSONAS = [
    _FULL,
    _FULL | {
        "persona_id": "broken", "profile": _FULL["profile"] | {"domain": "Finance Ops", "timezone": None, "role_title": ""}, "positioning": _FULL["positioning"] | {"method": ""}, "primary_segment": "s9", "proof": [{"id": "h0", "tier": "measured", "claim": "c", "source": None, "permission": "requested"}, {"id": "h7", "tier": None, "claim": "c"}],
        "pillars": [{"id": "p1", "promise": "x", "weight": 0.6, "maps_to_beliefs": ["b7", "b0"]}], "hot_takes": [{"id": "t1", "evidence_refs": ["h9"]}], "ladder": [{"rung": 2, "id": "l2", "cta_text": "", "serves": ["p1", "p8"]}], "paid_offers": [{"name": "map", "outcome": "", "price_model": "m", "proof_refs": ["h2"]}],
        "beliefs": [{"id": "b0", "claim": "c", "confidence": "high", "evidence_refs": []}, {"id": "b1", "claim": "", "confidence": "low", "evidence_refs": ["h0", "h8"]}], "samples": ["Wow \U0001f44d. Stop."], "voice": {"target_words": 14.0, "emoji": False},
    },
    {"persona_id": "empty"},
]

# --- evidence, and posts at every gate
PROOF_DDL = "id string, tier string, claim string, context string, subject string, source string, period string, permission string, metric struct<value:double,unit:string,period:string,baseline:string>"
PROOF = [
    {"id": "h1", "tier": "measured", "claim": "Invoices were matched in 14 minutes instead of 3 hours", "context": "a team of 12 clerks", "source": "stopwatch log 2024", "permission": "granted", "metric": {"value": 14, "unit": "minutes", "period": "26 weeks", "baseline": "180 minutes"}},
    {"id": "h2", "tier": "measured", "claim": "Refund backlog of the northern depot fell by 62 percent", "subject": "northern depot", "source": "ticket export", "period": "33 days", "permission": "requested", "metric": {"value": 62.5, "unit": "percent"}},
    {"id": "h3", "tier": "observed", "claim": "Nightly stock export finished earlier for the warehouse crew", "permission": "denied"},
]
POST_DDL = """id string, text string, status string, title string, pillar string, segment string, archetype string, belief_refs array<string>, proof_refs array<string>, offer_rung int, hook_pattern string, claim_level int, scheduled_for string, visibility string, feed_distribution string,
 approvals array<struct<decision:string,at:string,by:string>>, gate_bypassed boolean, score struct<total:double,band:string>, published struct<at:string,url:string>, notes string, image_brief string"""
_GOOD = {
    "text": "Match invoices in 14 minutes.\nName one owner, then \"write\" the step down.", "status": "approved", "title": "Fast match", "pillar": "p1", "segment": "s1", "archetype": "how_to", "belief_refs": ["b0", "b1"], "proof_refs": ["h1"], "offer_rung": 2, "hook_pattern": "number-list", "claim_level": 3,
    "scheduled_for": "2026-03-02T08:30:00Z", "approvals": [{"decision": "approved", "at": "2026-02-27T10:00:00Z", "by": "mira"}], "score": {"total": 82.5, "band": "approve"}, "notes": "lead with the time",
}
POSTS = [
    _GOOD | {"id": "good", "published": {"at": "2026-03-02T08:31:00Z", "url": "https://example.org/p/1"}},
    _GOOD | {"id": "edited", "approvals": [{"decision": "edited"}], "visibility": "PUBLIC", "feed_distribution": "MAIN_FEED", "scheduled_for": None, "offer_rung": None},
    _GOOD | {"id": "draft", "status": "draft"},
    _GOOD | {"id": "waiting", "status": "in_review"},
    _GOOD | {"id": "unsigned", "approvals": [{"decision": "rejected"}]},
    _GOOD | {"id": "blank", "text": " \n "},
    _GOOD | {"id": "unscored", "score": None},
    _GOOD | {"id": "weak", "score": {"total": 74.9, "band": "revise"}},
    _GOOD | {"id": "private", "visibility": "CONNECTIONS"},
    _GOOD | {"id": "sidefeed", "feed_distribution": "GROUP"},
    _GOOD | {"id": "invented", "text": "The refund backlog of our northern depot fell by 71 percent. It took 58 days."},
    _GOOD | {"id": "machine", "text": "As an AI I read every ledger. This is AI-generated."},
    _GOOD | {"id": "queued", "status": "queued", "approvals": None},
    _GOOD | {"id": "bypassed", "status": "queued", "approvals": [], "gate_bypassed": True},
    _GOOD | {"id": "out", "status": "published", "text": "Nightly stock export for the warehouse crew finished 45 minutes earlier."},
]
LADDER_DDL = "level int, label string"
LADDER = [{"level": 1, "label": "opinion"}, {"level": 2, "label": "observation"}, {"level": 3, "label": "measured"}]

# --- published history: too short a one, a balanced one, and one that has drifted
HISTORY_DDL = "feed string, seq long, text string, pillar string, archetype string, proof_refs array<string>"
_NOUNS = "ledger invoice receipt refund depot clerk budget payroll audit margin".split()
_WEIGHTS = {"p1": 0.5, "p2": 0.3, "p3": 0.2}
PLANNED = _WEIGHTS


def _post(feed: str, i: int, **more) -> dict:
    a, b = _NOUNS[i % 10], _NOUNS[(i * 7 + 3) % 10]
    pillar = "p1" if i % 10 < 5 else "p2" if i % 10 < 8 else "p3"
    text = f"Day {i}: your {a} and your {b} need number {i * i + 11}.\nI wrote step {i} of {a} {i} down and you can read {b} {i} now, item by item, before lunch."
    return {"feed": feed, "seq": i, "text": text, "pillar": pillar, "archetype": f"kind{i % 6}", "proof_refs": [f"h{i % 10}"]} | more


HISTORY = [_post("short", i) for i in range(2)] + [_post("even", i) for i in range(34)]
for _i in range(30):
    _more = {}
    if _i < 12:
        _more["archetype"] = "story"
    if _i % 4 == 0:
        _more["proof_refs"] = ["h1", "h2"]
    if _i % 6 == 1:
        _more["text"] = f"The same opening line!\nWe, us and our {_NOUNS[_i % 10]} {_i}. I keep my {_NOUNS[_i % 7]} {_i} to myself. \U0001f600\U0001f600\U0001f600\U0001f600"
    if _i in (20, 21):
        _more["text"] = "I wrote this twice, word for word, and my editor let me keep it in the feed."
    if _i % 2 == 0 or _i == 29:
        _more |= {"pillar": None if _i == 29 else "p3"}
    HISTORY.append(_post("drifted", _i, **_more))

# --- lines of a history file, and a file of voice samples
LINES = ['{"id": "1", "text": "one", "pillar": "p1", "archetype": "story", "proof_refs": ["h1", "h2"], "seq": 4}', '"a bare line"', "broken {", '{"pillar": "p2"}', '{"text": "two \\"quoted\\"", "seq": 5}', ""]
SAMPLES = [
    "# Samples\n## Sample 1\n" + "Name an owner for each step and close the month in five days. " * 2 + "\n<!-- a note -->\n---\n## Sample 2\nToo short.\n## Sample 3\n<!-- empty -->\n## Other\n" + "Not a sample. " * 9,
    "No heading at all. " * 6,
    "## Sample 7\n" + "Ask who owns the ledger before you buy a tool for it. " * 2 + "\nLast line.",
]
