"""The operators' queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: DuckDB: the words of a text.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS r
  FROM documents
), t AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY s) - 1 AS i FROM d GROUP BY s
), w AS (
  SELECT *, source_size * 2 AS cap, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t
), f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS l, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS k
  FROM w WINDOW b AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT s, source_size, cap, CAST(max_by(l, l / k) OVER () AS DOUBLE) * weight / CAST(max_by(k, l / k) OVER () AS DOUBLE) AS rise FROM f
), p AS (
  SELECT s, source_size, CASE WHEN cap <= rise THEN CAST(cap AS DOUBLE) ELSE rise END AS target FROM g
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size
         - coalesce(sum(size) OVER (PARTITION BY d.s ORDER BY r, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM d JOIN q USING (s)
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = f"""
WITH iw AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
     il AS (SELECT item_id, w, least(len(w), 10) AS l FROM iw WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT item_id, l, w, unnest(generate_series(1, len(w) - l + 1)) AS i FROM il)),
     dw AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents),
     pos AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS t FROM (SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
     occ AS (SELECT DISTINCT r, pos.l, i, t FROM pos JOIN (SELECT DISTINCT t FROM win) USING (t)),
     hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS p FROM occ) GROUP BY r),
     its AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ JOIN win USING (t) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 16)


# The rules of the URL query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Words whose pairs name hosts of a made-up block list, and the zones of these.
URL_NAMES = ("ad", "ads", "adult", "affiliate", "bet", "bets", "bingo", "bonus", "buy", "casino", "cheap", "click", "coupon", "crypto", "dating", "deal", "discount", "farm", "free", "gamble", "hack", "hot", "jackpot", "lender")
URL_NAMES += ("loan", "lottery", "malware", "mega", "miracle", "pharma", "phish", "pill", "pills", "poker", "popup", "prize", "promo", "replica", "sale", "sex", "shop", "slots", "spam", "spin", "track", "tracker", "traffic", "viagra", "warez", "win", "winner", "x", "xxx")
URL_ZONES = ("com", "net", "org", "info", "biz", "example.com", "example.net", "example.org")
_NAME_LIST = ", ".join(f"'{x}'" for x in URL_NAMES)
_ZONE_LIST = ", ".join(f"'{x}'" for x in URL_ZONES)


def url_list(spark: SparkSession) -> DataFrame:
    """(host, path, action, ruling): the query's rules, and every pair of different names in every zone as a listed host."""
    from textloom.llm.common import literal_table

    rules = literal_table(spark, [(*r, True) for r in URL_RULES], "host string, path string, action string, ruling boolean")
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, URL_NAMES))).alias("a")).select("a", F.explode(F.array(*map(F.lit, URL_NAMES))).alias("b")).filter("a <> b")
    zones = names.select("a", "b", F.explode(F.array(*map(F.lit, URL_ZONES))).alias("z"))
    return rules.unionByName(zones.select(F.concat_ws("-", "a", F.concat_ws(".", "b", "z")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("action"), F.lit(False).alias("ruling")))


def op10_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), url_list(spark))


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda x: -len(x[0] + x[1])))
OP10_SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path FROM pages),
     l AS (SELECT a || '-' || b || '.' || z AS listed FROM (SELECT unnest([{_NAME_LIST}]) AS a), (SELECT unnest([{_NAME_LIST}]) AS b), (SELECT unnest([{_ZONE_LIST}]) AS z) WHERE a <> b),
     h AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM u),
     t AS (SELECT DISTINCT host FROM (SELECT host, array_to_string(p[i:], '.') AS tail FROM (SELECT host, p, unnest(generate_series(1, len(p))) AS i FROM h)) JOIN l ON tail = listed),
     r AS (SELECT *, CASE {_FITS} END AS rule, starts_with(path, '/') AND host IN (SELECT host FROM t) AS listed FROM u)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for h, p, a in URL_RULES)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def _regex(template: str) -> str:
    """A license template as a pattern over words that each follow a space."""
    import re

    from textloom.llm.license_scan import tokens

    out = ""
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<beginOptional>>":
            out += "(?:"
        elif piece == "<<endOptional>>":
            out += ")?"
        elif piece.startswith("<<var"):
            least, most = piece.strip("<>").split(";")[1:]
            out += f"(?: [^ ]+){{{least},{most}}}"
        else:
            out += "".join(f" {w}" for w in tokens(piece))
    return out + "(?: |$)"


def _op2_sql() -> str:
    from textloom.llm.license_scan import BASE, TEMPLATES

    def places(phrase: str) -> str:
        w = phrase.split()
        return f"list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w))})"

    base = ", ".join(f"{places(p)} AS b{i}" for i, (p, _) in enumerate(BASE))
    b = [f"CASE WHEN len(b{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(BASE)]
    t = [f"CASE WHEN regexp_matches(s, '{_regex(x)}') THEN '{label}' END" for label, x in TEMPLATES]
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
     f AS (SELECT doc_id, len(w) AS n, ' ' || array_to_string(w, ' ') AS s, {base} FROM d),
     g AS (SELECT doc_id, n, list_concat(b0, list_concat(b1, b2)) AS p, {joined(b)} AS base_labels, {joined(t)} AS own, {joined(b + t)} AS labels FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, base_labels, labels,
       CASE WHEN own <> '' THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM g
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.suffix_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"], x["end"])), ",")
    return found.select("doc_id", "n_words", "n_repeated", "n_later", "repeated", text(F.col("spans")).alias("spans"), text(F.col("later_spans")).alias("later_spans"))


def op7_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.fill_middle import fill_middle, restore

    made = fill_middle(table(spark, sf_dir, "documents"))
    return made.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restore(F.col("output"), F.col("form")), 256)).drop("output")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), r AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), p AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), s AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k) GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS x FROM g WHERE f >= 100
), s AS (
  SELECT c.lang, c.phrase, c.k, c.x, c.f AS a, a.f AS l, b.f AS r, n, CAST(1000::HUGEINT * c.f * n // (a.f::HUGEINT * b.f) AS BIGINT) AS score, j
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c WHERE k > 1) AS c JOIN t USING (lang)
  JOIN c AS a ON a.lang = c.lang AND a.phrase = array_to_string(c.x[1:j], ' ') JOIN c AS b ON b.lang = c.lang AND b.phrase = array_to_string(c.x[j + 1:], ' ')
), m AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), o AS (
  SELECT DISTINCT m.lang, m.phrase FROM m JOIN (SELECT *, unnest(generate_series(2, k - 1)) AS z FROM c) AS y ON m.k = z AND m.lang = y.lang AND 100 * y.f >= 100 * m.a
  WHERE contains(' ' || y.phrase || ' ', ' ' || m.phrase || ' ')
), k AS (
  SELECT * FROM m ANTI JOIN o USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= 2000
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_scan_licenses": op2_scan_licenses,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mix_sources": op5_mix_sources,
        "op6_decontaminate": op6_decontaminate,
        "op7_extract_html": op7_extract_html,
        "op8_shard": op8_shard,
        "op9_identify_language": op9_identify_language,
        "op10_filter_urls": op10_filter_urls,
        "op11_fill_middle": op11_fill_middle,
        "op12_collocations": op12_collocations,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_scan_licenses": _op2_sql(), "op4_exact_dedup": OP4_SQL, "op5_mix_sources": OP5_SQL, "op6_decontaminate": OP6_SQL, "op10_filter_urls": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_collocations": OP12_SQL}
