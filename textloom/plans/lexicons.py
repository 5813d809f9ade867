"""Queries of dictionary matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.phrases import CTA, DICTIONARY, HOOKS
from textloom.functions.regex import B, round_half_up
from textloom.functions.text import whole
from textloom.operators import lexicon as L
from textloom.plans import duck as D
from textloom.plans.registry import query
from textloom.sources.tables import table

# Words of the driver's synthetic prose, which has few English phrases.
SAMPLE = ("the", "erthe", "worthless", "stupid", "licensed under", "all rights reserved", "la", "und", "tion the")
TERMS = DICTIONARY + [("sample", i, p) for i, p in enumerate(SAMPLE)]
DICT = "(VALUES " + ", ".join(f"({D.q(k)}, {i}, {D.q(p)})" for k, i, p in TERMS) + ") AS dict(kind, pos, phrase)"
_BARE = "regexp_replace(phrase, '^([^'']*)''', '\\1')"
_P = f"CASE WHEN strpos(low, phrase) > 0 THEN strpos(low, phrase) - 1 ELSE strpos(low, {_BARE}) - 1 END"
HITS = f"""(SELECT doc_id, kind, pos, phrase, position, len(string_split(substr(t, 1, position), chr(10))) AS line,
 CASE WHEN position - 48 > 0 THEN '...' ELSE '' END || substr(t, greatest(0, position - 48) + 1, least(length(t), position + length(phrase) + 48) - greatest(0, position - 48)) || CASE WHEN position + length(phrase) + 48 < length(t) THEN '...' ELSE '' END AS context
 FROM (SELECT doc_id, kind, pos, phrase, t, {_P} AS position FROM (SELECT doc_id, {D.whole()} AS t, lower({D.whole()}) AS low FROM documents), {DICT} WHERE contains(low, phrase) OR (contains(phrase, '''') AND contains(low, {_BARE}))))"""


def _occ(phrase: str) -> str:
    return f"CAST((length({D.normalised()}) - length(replace({D.normalised()}, {phrase}, ''))) // length({phrase}) AS INT)"


@query(f"SELECT doc_id, kind, phrase, CAST(position AS INT) AS position, CAST(line AS INT) AS line, context FROM {HITS}")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), TERMS).drop("pos")


@query("SELECT doc_id, " + ", ".join(f"(SELECT count(*) FROM {DICT} WHERE kind = '{k}' AND contains(lower({D.whole()}), phrase)) AS {k}" for k in ("hard", "soft", "vague", "authority", "sample")) + " FROM documents")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", L.matcher(TERMS)(F.lower(whole(F.col("text")))).alias("_ids"))
    return found.select("doc_id", *[L.present(k, F.col("_ids"), TERMS).alias(k) for k in ("hard", "soft", "vague", "authority", "sample")])


@query(f"WITH t AS MATERIALIZED (SELECT doc_id, {D.normalised()} AS t FROM documents) SELECT doc_id, kind, phrase, n FROM (SELECT doc_id, kind, phrase, CAST((length(t) - length(replace(t, phrase, ''))) // length(phrase) AS INT) AS n FROM t, {DICT} WHERE contains(t, phrase)) WHERE n >= 3")
def repeated_tells(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", L.normalised(F.col("text")).alias("_n"))
    found = docs.select("doc_id", "_n", F.explode_outer(F.filter(L.matcher(TERMS)("_n"), lambda i: i < len(TERMS))).alias("_i")).filter("_i is not null").select("doc_id", "_n", F.get(L._entries(TERMS), F.col("_i")).alias("_e"))
    n = ((F.length("_n") - F.length(F.replace("_n", "_e.phrase", F.lit("")))) / F.length("_e.phrase")).cast("int")
    return found.select("doc_id", "_e.kind", "_e.phrase", n.alias("n")).filter(F.col("n") >= least)


PREFER, AVOID = ["the", "and", "la", "und"], ["stupid", "worthless", "scum", "trash"]


def _word(p: str) -> str:
    return f"regexp_matches({D.whole()}, '(?i)(?:^|[^A-Za-z0-9_]){p}(?:$|[^A-Za-z0-9_])')"


@query(" UNION ALL ".join([f"SELECT doc_id, 'avoid' AS report, '{w}' AS word, {_occ(D.q(w))} AS n FROM documents WHERE {_word(w)}" for w in AVOID] + [f"SELECT doc_id, 'missing', '{w}', 0 FROM documents WHERE NOT {_word(w)}" for w in PREFER] + [f"SELECT doc_id, 'overuse', '{w}', {_occ(D.q(w))} FROM documents WHERE {_occ(D.q(w))} > 3" for w in PREFER]))
def vocabulary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.vocabulary(table(spark, sf_dir, "documents"), PREFER, AVOID)


_HEAD = f"({D.first_line()} || ' ' || array_to_string(string_split({D.whole()}, chr(10))[1:2], ' '))"
HOOK_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_HEAD}, {D.q(p.replace('{B}', chr(92) + 'b'))}) THEN {D.q(n)} END" for n, p in HOOKS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({HOOK_SQL}, ',') AS families, len({HOOK_SQL}) AS n_families FROM documents")
def hook_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.hook_families(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("_f")).select("doc_id", F.array_join("_f", ",").alias("families"), F.size("_f").alias("n_families"))


def _first(p: str) -> str:
    p = p.replace("{B}", r"\b")
    return f"CASE WHEN regexp_matches({D.whole()}, {D.q(p)}) THEN length(string_split_regex({D.whole()}, {D.q(p)})[1]) END"


CTA_SQL = "list_filter([" + ", ".join(_first(p) for _, p in CTA) + "], lambda x: x IS NOT NULL)"
_CR = f"CASE WHEN len(c) > 0 THEN list_min(c)::DOUBLE / greatest(length({D.whole()}), 1) ELSE 1.0::DOUBLE END"


@query(f"SELECT doc_id, len(c) AS n_ctas, {D.rnd(_CR, 4)} AS cta_ratio FROM (SELECT doc_id, text, {CTA_SQL} AS c FROM documents)")
def cta_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "text", L.cta_positions(F.col("text")).alias("_c"))
    return base.select("doc_id", F.size("_c").alias("n_ctas"), round_half_up(cta_ratio(F.col("_c"), F.col("text")), 4).alias("cta_ratio"))


def cta_ratio(positions, text):
    return F.when(F.size(positions) > 0, F.array_min(positions) / F.greatest(F.length(whole(text)), F.lit(1))).otherwise(F.lit(1.0))
