"""Text measurements as Column functions; null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.regex import B, count, extract, let, occurrences, round_half_up, trim

# Patterns and word lists of the measurements.
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-]*"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{200D}\x{20E3}]"
HASHTAG = r"(^|\s)#[\p{L}\p{N}_]+"
FIRST = "i|i'm|i've|ive|i'll|i'd|my|mine|me|we|we're|we've|our|us"
SECOND = "you|you're|you've|you'll|you'd|your|yours"
THIRD = "they|them|their|theirs|he|him|his|she|her|hers|it|its"
UNITS = "%|percent|x|hours?|hrs?|days?|weeks?|months?|years?"
IMPERATIVES = (
    "use", "start", "stop", "write", "build", "measure", "track", "ask", "try", "check", "pick", "choose", "drop", "add", "remove", "test", "ship", "document", "define",
    "list", "block", "automate", "reorder", "review", "audit", "log", "tag", "standardise", "standardize", "schedule", "run", "read", "look", "find", "count", "compare",
    "cut", "replace", "move", "write down", "write it down", "put", "keep", "make", "give", "take", "send", "call", "book", "share", "note", "set", "decide", "name", "delete",
    "skip", "start with", "end with", "begin", "finish", "avoid", "expect", "assume", "ignore", "waste", "pay", "hire", "fire", "fix",
)
VERBS = "|".join(IMPERATIVES)
STOPWORDS = (
    "a about after all also am an and any are as at be because been before being but by can cannot could did do does doing done down each even every for from get got had has have he her here "
    "hers him his how i if in into is it its just like me more most my no nor not of off on once only or other our out over own said same she should so some such than that the their them then "
    "there these they this those through to too under until up us use used very was we were what when where which while who why will with would you your yours"
).split()


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return extract(whole(text), WORD)


def sentences(text: Column) -> Column:
    """Sentences of a text; a list marker stays with its item, and a line end alone is no break."""
    # A text is only rewritten for marks that it has.
    has = lambda pattern, f: lambda t: F.when(t.rlike(pattern), f(t)).otherwise(t)
    lead = r"(^|\n|(?<=[.!?]\s))\s*(\d{1,2})"
    t = let(whole(text), lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    t = trim(F.regexp_replace(t, r"\n+", " \n "))
    t = let(t, has(r"[-*•]\s", lambda t: F.regexp_replace(t, r"(?:^|\n)\s*[-*•]\s+", "\x01- ")))
    t = let(t, has(r"\d\.\s", lambda t: F.regexp_replace(t, lead + r"\.\s+", "$1$2\x02\x01")))
    t = let(t, has(r"\d\)\s", lambda t: F.regexp_replace(t, lead + r"\)\s+", "$1$2\x01")))
    parts = F.split(t, "(?<=[.!?])\\s+(?=[A-Z0-9\"'(\\[]|\x01)")
    return F.filter(F.transform(parts, lambda s: trim(F.replace(F.replace(s, F.lit("\x01"), F.lit(" ")), F.lit("\x02"), F.lit(".")))), lambda s: s != "")


def lengths_of(sentences_: Column) -> Column:
    """Words of each sentence."""
    return F.transform(sentences_, lambda s: count(s, WORD))


def sentence_lengths(text: Column) -> Column:
    return lengths_of(sentences(text))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(whole(text), r"\n\s*\n"), trim), lambda p: p != "")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(whole(text), "\n"), trim), lambda x: x != ""), F.lit(0)), F.lit(""))


def last_lines(text: Column, n: int = 2) -> Column:
    kept = F.filter(F.transform(F.split(whole(text), "\n"), trim), lambda x: x != "")
    return F.when(F.size(kept) <= n, kept).otherwise(F.slice(kept, -n, n))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def sentence_at(text: Column, offset: Column, size: Column) -> Column:
    """The sentence around `size` characters from a 0-based offset on: from the full stop before to the one after, white space collapsed."""
    head, tail = F.substring(text, F.lit(1), offset), F.substring(text, offset + size + 1, F.length(text))
    whole_ = F.concat(F.substring_index(head, ".", -1), F.substring(text, offset + 1, size), F.substring_index(tail, ".", 1))
    return trim(F.regexp_replace(whole_, r"\s+", " "))


def years(text: Column) -> Column:
    """array<int> of the years from 1900 to 2099 in a text."""
    return F.transform(extract(whole(text), rf"{B}(?:19|20)[0-9]{{2}}{B}"), lambda y: y.cast("int"))


def first_year(period: Column) -> Column:
    """The first year of a period, null if there is none."""
    return F.get(years(period), F.lit(0))


def end_year(period: Column) -> Column:
    """The last year of a period; 9999 if it runs on, null if it has no year."""
    return F.when(whole(period).rlike(rf"(?i){B}(?:present|current|now|today){B}"), F.lit(9999)).otherwise(F.array_max(years(period)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def mean(a: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0)).otherwise(F.lit(0.0))


def stdev(a: Column) -> Column:
    """Sample standard deviation of integers, from exact sums; 0 below two values."""
    n = F.size(a).cast("long")
    squares = F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y * y)
    return F.when(n > 1, F.sqrt((n * squares - total(a) * total(a)).cast("double") / (n * (n - 1)))).otherwise(F.lit(0.0))


def variation(a: Column) -> Column:
    return F.when(total(a) > 0, stdev(a) / mean(a)).otherwise(F.lit(0.0))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; in a text of ASCII characters alone lower() does that, and faster."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores in lower case, in which pronouns are counted."""
    return F.split(ascii_lower(whole(text)), "[^a-z0-9_]+")


def emoji_count(text: Column) -> Column:
    """Emoji of a text; none are ASCII."""
    t = whole(text)
    return F.when(is_ascii(t), F.lit(0)).otherwise(count(t, EMOJI))


def pronouns(tokens_: Column, which: str) -> Column:
    """How many tokens are pronouns of a list.  A short form counts by what stands before its apostrophe, which is in each list."""
    return F.size(F.filter(tokens_, lambda w: w.isin([p for p in which.split("|") if "'" not in p])))


def second_to_first(second: Column, first: Column, n_words: Column) -> Column:
    """Second per first person; without first person, second person per 100 words."""
    w = F.greatest(n_words, F.lit(1))
    s, f = second / w * 100, first / w * 100
    return F.when(first == 0, s).otherwise(s / f)


#: A digit with no word character before it.
DIGIT = r"[0-9](?<![A-Za-z0-9_][0-9])"


def numbers(text: Column) -> Column:
    """Numeric tokens, with thousands and a unit of time or part."""
    return extract(whole(text), rf"(?i){DIGIT}[0-9,.]*\s?(?:{UNITS}|k|m|bn)?{B}")


def claim_numbers(text: Column) -> Column:
    """Numeric tokens as a sourced claim gives them, trimmed."""
    return F.transform(extract(whole(text), rf"(?i){DIGIT}[0-9]*(?:[.,][0-9]+)?\s?(?:{UNITS})?{B}"), trim)


def imperatives(text: Column) -> Column:
    return imperatives_of(sentences(text))


def imperatives_of(sentences_: Column) -> Column:
    """The sentences that begin with a verb of IMPERATIVES, behind a list marker or not."""
    return F.filter(sentences_, lambda s: s.rlike(rf"(?i)^(?:[0-9]{{1,2}}[.)]\s+|[-*•]\s+)?(?:{VERBS}){B}"))


def hashtags(text: Column) -> Column:
    return F.transform(extract(whole(text), HASHTAG), lambda h: F.regexp_replace(trim(h), "^#", ""))


def normalised(text: Column) -> Column:
    """Lower case, plain quotes and hyphens, white space collapsed."""
    out = F.lower(whole(text))
    for fancy, plain in zip("‘’“”–—", "''\"\"--"):
        out = F.replace(out, F.lit(fancy), F.lit(plain))
    return F.regexp_replace(out, r"\s+", " ")


def hook_key(text: Column) -> Column:
    """The first line as a key of equal openings."""
    return trim(F.regexp_replace(F.lower(first_line(text)), "[^a-z0-9 ]", ""))


def grams(w: str, n: int = 4) -> Column:
    """Distinct runs of n words of the column w, an array of lower-cased words."""
    return F.expr(f"if(size({w}) >= {n}, array_distinct(transform(sequence(1, size({w}) - {n - 1}), i -> array_join(slice({w}, i, {n}), ' '))), cast(array() as array<string>))")


def reading_seconds(n_words: Column, wpm: int = 238) -> Column:
    return F.floor(n_words / F.lit(wpm) * 60 + 0.5)


def truncated(text: Column, n: int) -> Column:
    t = trim(F.regexp_replace(whole(text), r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


COUNTS = {
    "exclamations": "!",
    "ellipses": r"\.\.\.",
    "semicolons": ";",
    "colons": ":",
    "dashes": "—|–",
    "commas": ",",
    "questions": r"\?",
}
#: The marks of COUNTS, of which each place counts.
LITERALS = {"exclamations": "!", "ellipses": "...", "semicolons": ";", "colons": ":", "dashes": "—–", "commas": ",", "questions": "?"}
CONTRACTION = r"(?i)(?<![A-Za-z0-9_])[A-Za-z0-9_]++'(?:s|t|re|ve|ll|d|m)(?![A-Za-z0-9_])"


def punctuation(text: Column) -> dict[str, Column]:
    """The counts of COUNTS, without regular expressions."""
    t = whole(text)
    return {k: occurrences(t, v) if k == "ellipses" else sum((occurrences(t, c) for c in v[1:]), occurrences(t, v[0])) for k, v in LITERALS.items()}


def contractions(text: Column) -> Column:
    t = whole(text)
    return F.when(t.contains("'"), count(t, CONTRACTION)).otherwise(0)


def hashtag_count(text: Column) -> Column:
    t = whole(text)
    return F.when(t.contains("#"), count(t, HASHTAG)).otherwise(0)


def style_profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with 21 numeric columns of style; the words of each sentence are counted once, and tokens cut once.

    No word reaches across the end of a sentence, so the sentences' words are the text's.
    """
    text = F.col(text_col)
    base = docs.withColumns({"_lens": sentence_lengths(text), "_tokens": tokens(text)})
    out = {
        "chars": F.length(whole(text)),
        "words": total(F.col("_lens")).cast("int"),
        "sentences": F.size("_lens"),
        "mean_sentence_words": round_half_up(mean(F.col("_lens")), 2),
        "median_sentence_words": round_half_up(median(F.col("_lens")), 2),
        "length_variance": round_half_up(variation(F.col("_lens")), 3),
        "paragraphs": F.size(paragraphs(text)),
        "emoji": emoji_count(text),
        "hashtags": hashtag_count(text),
        "numbers": F.size(numbers(text)),
        "first_person": pronouns(F.col("_tokens"), FIRST),
        "second_person": pronouns(F.col("_tokens"), SECOND),
        "third_person": pronouns(F.col("_tokens"), THIRD),
        "contractions": contractions(text),
    } | punctuation(text)
    return base.withColumns(out).drop("_lens", "_tokens")


STYLE_FIELDS = ("chars", "words", "sentences", "mean_sentence_words", "median_sentence_words", "length_variance", "paragraphs", "emoji", "hashtags", "questions", "numbers", "first_person", "second_person", "third_person", "exclamations", "ellipses", "semicolons", "colons", "dashes", "commas", "contractions")
# Weights of style similarity.
STYLE_WEIGHTS = (("mean_sentence_words", 0.22), ("length_variance", 0.16), ("paragraphs", 0.08), ("exclamations", 0.04), ("questions", 0.08), ("commas", 0.08), ("dashes", 0.04), ("contractions", 0.08), ("hashtags", 0.08), ("numbers", 0.08), ("emoji", 0.06))


def style_similarity(a, b) -> Column:
    """Weighted closeness of two style profiles, 0 to 1; a and b map a field to its Column."""
    out = F.lit(0.0)
    for field, weight in STYLE_WEIGHTS:
        x, y = a(field), b(field)
        scale = F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        out = out + F.lit(weight) * (F.lit(1.0) - F.least(F.lit(1.0), F.abs(x - y) / scale))
    return round_half_up(out, 3)
