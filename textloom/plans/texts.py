"""Queries of text measurement and style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.regex import count, round_half_up
from textloom.plans import duck as D
from textloom.plans.registry import query
from textloom.sources.tables import table

DOC = "documents"


@query(f"SELECT doc_id, {D.count(D.whole(), T.WORD)} AS n_words, length({D.whole()}) AS n_chars_all, {', '.join(f'{D.count(D.whole(), p)} AS {k}' for k, p in T.COUNTS.items())}, {D.STYLE['contractions']} AS contractions FROM documents")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.whole(F.col("text"))
    return table(spark, sf_dir, DOC).select("doc_id", count(text, T.WORD).alias("n_words"), F.length(text).alias("n_chars_all"), *[c.alias(k) for k, c in T.punctuation(text).items()], T.contractions(text).alias("contractions"))


@query(f"SELECT doc_id, len(l) AS n_sentences, {D.rnd(D.mean('l'), 2)} AS mean_words, {D.rnd(D.median('l'), 2)} AS median_words, {D.rnd(D.stdev('l'), 3)} AS sd_words, {D.rnd(D.variation('l'), 3)} AS variation FROM (SELECT doc_id, {D.lengths()} AS l FROM documents)")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = F.col("_l")
    base = table(spark, sf_dir, DOC).select("doc_id", T.sentence_lengths(F.col("text")).alias("_l"))
    return base.select("doc_id", F.size("_l").alias("n_sentences"), *[round_half_up(f(lens), d).alias(n) for n, f, d in (("mean_words", T.mean, 2), ("median_words", T.median, 2), ("sd_words", T.stdev, 3), ("variation", T.variation, 3))])


@query(f"SELECT doc_id, len(p) AS n_paragraphs, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS longest, len(string_split({D.whole()}, chr(10))) AS n_lines, {D.first_line()} AS first_line, {D.hook_key()} AS hook_key FROM (SELECT doc_id, text, {D.paragraphs()} AS p FROM documents)")
def paragraph_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.paragraphs(F.col("text"))
    longest = F.coalesce(F.array_max(F.transform(p, F.length)), F.lit(0))
    return table(spark, sf_dir, DOC).select("doc_id", F.size(p).alias("n_paragraphs"), longest.alias("longest"), F.size(F.split(T.whole(F.col("text")), "\n", -1)).alias("n_lines"), T.first_line(F.col("text")).alias("first_line"), T.hook_key(F.col("text")).alias("hook_key"))


_W = D.count(D.whole(), T.WORD)
RATIO = "CASE WHEN f = 0 THEN s::DOUBLE / greatest(w, 1) * 100 ELSE (s::DOUBLE / greatest(w, 1) * 100) / (f::DOUBLE / greatest(w, 1) * 100) END"


@query(f"SELECT doc_id, f AS first_person, s AS second_person, t AS third_person, {D.rnd(RATIO, 2)} AS second_to_first, CAST(floor(w::DOUBLE / 238 * 60 + 0.5) AS BIGINT) AS reading_seconds FROM (SELECT doc_id, {D.pronouns(T.FIRST)} AS f, {D.pronouns(T.SECOND)} AS s, {D.pronouns(T.THIRD)} AS t, {_W} AS w FROM documents)")
def pronoun_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    cut = table(spark, sf_dir, DOC).select("doc_id", T.tokens(text).alias("_t"), count(T.whole(text), T.WORD).alias("_w"))
    base = cut.select("doc_id", *[T.pronouns(F.col("_t"), p).alias(n) for n, p in (("first_person", T.FIRST), ("second_person", T.SECOND), ("third_person", T.THIRD))], "_w")
    ratio = T.second_to_first(F.col("second_person"), F.col("first_person"), F.col("_w"))
    return base.select("doc_id", "first_person", "second_person", "third_person", round_half_up(ratio, 2).alias("second_to_first"), T.reading_seconds(F.col("_w")).alias("reading_seconds"))


@query(f"SELECT doc_id, value, count(*) AS n, regexp_matches(regexp_replace(value, '[^0-9.,]', '', 'g'), '^(?:[0-9]{{4}}|[1-9]|10)$') AS structural FROM (SELECT doc_id, unnest({D.claim_numbers()}) AS value FROM documents) GROUP BY ALL")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, DOC).select("doc_id", F.explode(T.claim_numbers(F.col("text"))).alias("value"))
    return tokens.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("structural", F.regexp_replace("value", "[^0-9.,]", "").rlike("^(?:[0-9]{4}|[1-9]|10)$"))


@query(f"SELECT doc_id, len(i) AS n_imperatives, coalesce(i[1], '') AS first_imperative FROM (SELECT doc_id, {D.imperatives()} AS i FROM documents)")
def imperatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, DOC).select("doc_id", T.imperatives(F.col("text")).alias("_i")).select("doc_id", F.size("_i").alias("n_imperatives"), F.coalesce(F.get("_i", F.lit(0)), F.lit("")).alias("first_imperative"))


@query(f"SELECT doc_id, {', '.join(T.STYLE_FIELDS)} FROM {D.style()}")
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.style_profile(table(spark, sf_dir, DOC).select("doc_id", "text")).select("doc_id", *T.STYLE_FIELDS)


#: Means of rounded measures are taken over thousandths, so that sums are exact in any order.
def _mean_of(c: str) -> str:
    return D.rnd(f"CAST(sum(CAST(floor({c} * 1000.0::DOUBLE + 0.5) AS BIGINT)) AS DOUBLE) / 1000.0::DOUBLE / count(*)", 3)


def _mean(c: str):
    return round_half_up(F.sum(F.floor(F.col(c) * F.lit(1000.0) + 0.5)).cast("double") / F.lit(1000.0) / F.count(F.lit(1)), 3)


_AGG = ", ".join(f"{_mean_of(c)} AS {c}" for c in T.STYLE_FIELDS)


@query(f"SELECT source, {_AGG}, count(*) AS samples FROM {D.style()} GROUP BY source")
def style_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = T.style_profile(table(spark, sf_dir, DOC).select("source", "text"))
    return profiles.groupBy("source").agg(*[_mean(c).alias(c) for c in T.STYLE_FIELDS], F.count(F.lit(1)).alias("samples"))


_SIM = " + ".join(f"{w}::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(p.{k} - a.{k}) / greatest(abs(p.{k}), abs(a.{k}), 1.0::DOUBLE)))" for k, w in T.STYLE_WEIGHTS)


@query(f"WITH p AS {D.style()}, a AS (SELECT source, {_AGG} FROM p GROUP BY source) SELECT doc_id, {D.rnd(f'0.0::DOUBLE + {_SIM}', 3)} AS similarity FROM p JOIN a USING (source)")
def style_similarity_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [k for k, _ in T.STYLE_WEIGHTS]
    profiles = T.style_profile(table(spark, sf_dir, DOC).select("doc_id", "source", "text")).select("doc_id", "source", *keys)
    # One row for each source.
    means = profiles.groupBy("source").agg(*[_mean(c).alias(f"_{c}") for c in keys])
    return profiles.join(means, "source").select("doc_id", T.style_similarity(F.col, lambda k: F.col(f"_{k}")).alias("similarity"))


_STOP = ", ".join(D.q(w) for w in T.STOPWORDS)


@query(f"""SELECT lang, word, n, CAST(r AS INT) AS rank FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
 FROM (SELECT lang, unnest({D.words(f"lower({D.whole()})")}) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN ({_STOP}) GROUP BY lang, word) WHERE r <= 25""")
def top_terms(spark: SparkSession, sf_dir: str, limit: int = 25) -> DataFrame:
    terms = table(spark, sf_dir, DOC).select("lang", F.explode(T.words(F.lower(T.whole(F.col("text"))))).alias("word"))
    n = terms.filter((F.length("word") >= 4) & ~F.col("word").isin(T.STOPWORDS)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # Spark keeps the best rows of each group before it shuffles them.
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= limit)


@query(f"SELECT conv_id, turn, {D.count(D.whole(), T.HASHTAG)} AS hashtags, {D.count(D.whole(), T.EMOJI)} AS emoji, array_to_string(list_transform({D.extract(D.whole(), T.HASHTAG)}, lambda h: regexp_replace({D.trim('h')}, '^#', '')), ' ') AS tags FROM conversations")
def hashtag_emoji(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.whole(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", count(text, T.HASHTAG).alias("hashtags"), count(text, T.EMOJI).alias("emoji"), F.array_join(T.hashtags(F.col("text")), " ").alias("tags"))
