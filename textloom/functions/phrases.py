"""Phrase lists. Fixed values, in the order in which they are reported."""

from __future__ import annotations

HARD_BANS = (
    "as an ai", "as a language model", "ai-generated", "ai generated", "in this response", "i cannot browse", "i dont have access to", "i do not have access to", "hope this helps",
    "here is the rewritten", "delve into", "delve into the world", "dive deep into", "deep dive into", "navigate the landscape", "navigating the landscape", "ever-evolving landscape",
    "ever-changing landscape", "fast-paced world", "fast paced world", "rapidly evolving", "rapidly changing", "in todays world", "in today s world", "in todays digital age",
    "the digital age", "digital transformation journey", "unlock the power", "unleash the power", "unlock your potential", "take it to the next level", "elevate your", "game-changer",
    "game changer", "game-changing", "revolutionary", "disruptive", "cutting-edge", "cutting edge", "best-in-class", "world-class", "next-level", "supercharge", "10x", "skyrocket",
    "explode your", "crush it", "synergy", "synergies", "synergize", "synergise", "holistic approach", "holistic strategy", "robust solution", "comprehensive ecosystem",
    "leverage synergies", "actionable insights", "key learnings", "key takeaways", "value-add", "value proposition", "thought leader", "thought leadership", "paradigm shift",
    "mindset shift", "growth mindset", "north star", "bandwidth", "circle back", "touch base", "low-hanging fruit", "move the needle", "level up", "evergreen content", "content machine",
    "personal brand journey", "here is the thing", "here's the thing", "let that sink in", "buckle up", "without further ado", "picture this", "imagine this", "read that again",
    "sit with that", "let me be honest", "lets be honest", "let's be honest", "i will not sugarcoat", "no fluff", "in conclusion", "to sum up", "furthermore", "moreover", "additionally",
    "it is important to note", "it's important to note", "needless to say", "at the end of the day", "when it comes to", "in terms of", "the fact of the matter", "one thing is clear",
    "only time will tell", "exciting times ahead", "the best is yet to come", "like and share", "smash that", "drop a comment if you agree", "comment below and ill",
    "tag someone who needs to see", "follow for more", "follow the page", "this will change your life", "this changed everything", "this changed my life", "this is the way",
)
SOFT_TELLS = (
    "i have seen", "in my experience", "the truth is", "let that be said", "here is the kicker", "you are not alone", "its not just", "not just a", "the real question is", "obviously",
    "simply", "just", "literally", "actually", "really", "very", "truly", "seamlessly", "empower", "leverage", "utilize", "robust", "significant", "substantial", "impressive", "innovative",
    "exciting", "transformative", "seamless experience", "passion", "passionate about", "results-driven", "detail-oriented", "self-starter", "proven track record", "i think", "i believe",
    "i would say", "kind of", "sort of", "i guess", "studies show", "research shows", "experts say", "it is well known", "industry standard", "best practice", "cutting", "basically",
    "essentially", "in order to", "due to the fact that", "at the end of the", "a variety of", "a range of", "various", "numerous", "several", "significantly", "dramatically", "extremely",
    "crucial", "vital", "essential", "it is important", "very important",
)
VAGUE_QUANTIFIERS = (
    "many", "most", "almost all", "nearly all", "a lot of", "lots of", "tons of", "plenty of", "majority of", "some", "few", "several", "countless", "dozens", "hundreds of", "thousands of",
)
UNSOURCED_AUTHORITY = (
    "studies show", "study shows", "research shows", "research proves", "experts say", "experts agree", "data shows", "data proves", "statistics show", "it is well known", "widely known",
    "widely accepted", "studies have shown", "research has found", "according to research", "sources show", "it is proven", "proven fact", "well documented",
)
# Hook families and markers of a call to action.  {B} stands for an ASCII word boundary, as Java's own is not ASCII.
HOOKS = (
    ("cost-first", r"(?i)cost you|you pay for|costs? (?:you|them)|burning|wasting|revenue (?:you|we) lose|lost (?:revenue|money|time)"),
    ("wrong-belief", r"(?i)most (?:people|companies|teams) (?:think|believe|assume)|everyone (?:thinks|believes)|is wrong|not actually|myth"),
    ("observation", r"(?i)I(?:'ve| have)? (?:noticed|seen|watched)|over the last \d+|these past \d+|since \d{4}"),
    ("number-list", r"(?i)^\s*\d+|[one two three four five six seven eight nine ten]+\s+(?:ways|things|steps|reasons|rules|lessons|mistakes)"),
    ("direct-question", r"(?i)\?\s*$|^(?:why|what|how|when|which|who|where|do|does|did|is|are|should|would|could|can){B}"),
    ("contrast", r"but|however|except|instead|yet the|despite"),
    ("story-open", r"(?i)^last (?:week|month|year|night)|when I|back in \d{4}|the day I|first time I"),
    ("consequence", r"(?i)cost|consequence|ends? up|result is|what happens (?:when|if)|leads? to"),
    ("proof-first", r"(?i)\d+%|{B}\d+x{B}|\d+ (?:hours?|days?|weeks?|months?|clients?|customers?)"),
    ("demonstrable", r"(?i)here(?:'s| is) (?:how|the|a)|step \d|first, |copy this"),
)
CTA = (
    ("ask", r"(?i){B}(?:comment|DM|dm me|message me|reply|drop a|leave a|send me|email me|tell me|let me know){B}"),
    ("link", r"(?i){B}(?:link|URL|url) (?:is )?(?:in|below){B}"),
    ("read", r"(?i){B}(?:read|full (?:guide|breakdown|version)) (?:more )?(?:here|below|in the){B}"),
    ("follow", r"(?i){B}(?:follow|connect with me|add me){B}"),
    ("save", r"(?i){B}save this{B}"),
    ("book", r"(?i){B}(?:sign up|get access|book|book a|call|grab){B}"),
    ("question", r"(?m)\?\s*$"),
)

KINDS = (("hard", HARD_BANS), ("soft", SOFT_TELLS), ("vague", VAGUE_QUANTIFIERS), ("authority", UNSOURCED_AUTHORITY))
DICTIONARY = [(kind, i, p) for kind, phrases in KINDS for i, p in enumerate(phrases)]
