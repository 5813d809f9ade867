"""Numeric claims against a registry of sourced evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.regex import B, extract
from textloom.functions.text import DIGIT, claim_numbers, whole

#: Numbers that structure a text rather than claim something.
STRUCTURAL = "^(?:[0-9]{4}|[1-9]|10)$"


def bare(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9.,]", "")


def known_numbers(registry: DataFrame, *text_cols: str) -> DataFrame:
    """Distinct column value: the numbers, bare and with their units, of the registry's texts."""
    tokens = registry.select(F.explode(claim_numbers(F.concat_ws("\n", *text_cols))).alias("_t"))
    return tokens.select(F.explode(F.array("_t", bare(F.col("_t")))).alias("value")).distinct()


#: A number in the text of a registry.
NUMBER = rf"{DIGIT}[0-9]*(?:[.,][0-9]+)?{B}"


def harvest(value: Column, kind: T.DataType) -> Column:
    """array<string> of all numbers in a value of any nesting: of its texts, and its own."""
    none = F.expr("cast(array() as array<string>)")
    if isinstance(kind, T.StructType):
        parts = [harvest(value.getField(f.name), f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: harvest(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: harvest(x, kind.valueType))), none)
    if isinstance(kind, T.StringType):
        return extract(whole(value), NUMBER)
    if isinstance(kind, T.NumericType):
        return F.when(value.isNull(), none).otherwise(F.array(F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))))
    return none


def registry_numbers(registry: DataFrame, *cols: str) -> DataFrame:
    """Distinct column value: all numbers in the columns of a registry, whatever their nesting."""
    found = F.concat(*[harvest(F.col(c), registry.schema[c].dataType) for c in cols])
    return registry.select(F.explode(found).alias("value")).distinct()


def unsourced(posts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, value, claim): numeric tokens that are not structural and not known, and the sentence around the first place of each value.

    known: column value.  Numbers that belong to names (of a method, a domain, a keyword) are no claims: add those of registry_numbers
    over the names.
    """
    text = whole(F.col(text_col))
    rows = posts.select(id_col, text.alias("_t"), F.posexplode_outer(claim_numbers(F.col(text_col))).alias("pos", "value")).filter("value is not null").withColumn("_bare", bare(F.col("value")))
    open_ = rows.filter((F.col("_bare") != "") & ~F.col("_bare").rlike(STRUCTURAL))
    k = known.select(F.col("value").alias("_k"))
    missing = open_.join(k, F.col("_bare") == F.col("_k"), "left_anti").join(k, F.col("value") == F.col("_k"), "left_anti")
    at = F.instr("_t", F.col("value"))
    head, tail = F.substring(F.col("_t"), F.lit(1), at), F.substring(F.col("_t"), at + F.length("value"), F.length("_t"))
    start = F.substring_index(head, ".", -1)
    claim = F.regexp_replace(F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.col("value"), F.substring_index(tail, ".", 1)), r"^\s+|\s+$", "")
    return missing.select(id_col, "pos", "value", F.when(F.length(claim) > 200, F.concat(F.substring(claim, 1, 200), F.lit("…"))).otherwise(claim).alias("claim"))


#: Words that are broadcast at most, counted first; beyond, Spark shuffles.
MOST_BROADCAST = 1_000_000


#: Words of an entry that a claim must hold before its text is compared; fewer if the entry needs fewer.
FIRST_MET = 2


def _fours(rows: DataFrame, token: str) -> DataFrame:
    """rows with column _four: a row for each run of four characters of the token, which has four or more."""
    # Places are exploded, not the runs: these are then cut in compiled code.
    at = rows.select("*", F.explode_outer(F.sequence(F.lit(1), F.length(token) - 3)).alias("_i"))
    return at.select(*rows.columns, F.substr(token, "_i", F.lit(4)).alias("_four"))


def nearest_claim(claims: DataFrame, registry: DataFrame, registry_id: str = "item_id", registry_text: str = "text", least: float = 0.4, most_broadcast: int = MOST_BROADCAST, only_found: bool = False) -> DataFrame:
    """claims with entry and score: the entry of which most words of over 3 letters stand in the claim; null below `least` (with only_found: no row); ties by entry id.

    An inverted index finds the candidates.  An entry of s words needs k = ceil(least * s) of them in the claim, so at least m of its
    s - k + m rarest stand there, for any m up to k: only these are looked for, and an entry with fewer than m (FIRST_MET) is never
    compared.  A word stands in a claim only if one of the claim's runs of letters and digits holds it, so it is posted under the one of
    its runs of four that fewest words have, and claims look up their own.  What is met is a bit of the entry, so copies and repeats
    count once.  Candidates are then counted on all words of the entry.  Nothing of the registry reaches the driver but a count.
    """
    tokens = lambda c: F.array_distinct(extract(F.lower(whole(c)), "[a-z0-9]{4,}"))
    entries = registry.select(F.col(registry_id).alias("_entry"), tokens(F.col(registry_text)).alias("_words")).filter(F.size("_words") > 0)
    holds = entries.select("_entry", F.explode("_words").alias("_word"))
    # A word is as rare as the rarest of its runs in the words of the registry; of equal ones the longer come first: claims hold them less often.
    spelled = _fours(holds, "_word").distinct()
    shared = spelled.groupBy("_four").agg(F.count(F.lit(1)).alias("_n"))
    rarity = spelled.select("_word", "_four").distinct().join(shared, "_four").groupBy("_word").agg(F.min(F.struct("_n", "_four")).alias("_rarest")).select("_word", F.col("_rarest._n").alias("_df"), F.col("_rarest._four").alias("_four"))
    ranked = holds.join(rarity, "_word").groupBy("_entry").agg(F.sort_array(F.collect_list(F.struct("_df", (-F.length("_word")).alias("_l"), "_word"))).alias("_r"))
    need = F.ceil(F.lit(least) * F.size("_r") - F.lit(1e-9)).cast("int")
    sized = ranked.withColumn("_need", F.greatest(need, F.lit(1))).withColumn("_m", F.least(F.lit(FIRST_MET), "_need"))
    # The words looked for are bits of a long; an entry with more is compared when one is met.
    sized = sized.withColumn("_m", F.when(F.size("_r") - F.col("_need") + F.col("_m") > 64, F.lit(1)).otherwise(F.col("_m")))
    looked = sized.select("_entry", "_m", F.posexplode(F.slice("_r", F.lit(1), F.size("_r") - F.col("_need") + F.col("_m"))).alias("_at", "_w"))
    postings = looked.groupBy(F.col("_w._word").alias("_word")).agg(F.collect_list(F.struct("_entry", "_m", F.expr("shiftleft(1L, _at % 64)").alias("_bit"))).alias("_posted"))
    index = postings.join(rarity.select("_word", "_four"), "_word")
    small_ = (lambda df: F.broadcast(df)) if holds.count() <= most_broadcast else (lambda df: df)
    base = claims.withColumn("_key", F.xxhash64(*[c for c, kind in claims.dtypes if "map<" not in kind]))
    # Not explode(): Spark would add a filter on the array's size and push it, with all that makes the array, below.
    runs = base.select("_key", F.explode_outer(tokens(F.col("claim"))).alias("_token")).filter("_token is not null")
    met = _fours(runs, "_token").join(small_(index), "_four").filter(F.contains("_token", F.col("_word"))).select("_key", F.explode("_posted").alias("_p"))
    pairs = met.groupBy("_key", F.col("_p._entry").alias("_entry")).agg(F.bit_or("_p._bit").alias("_bits"), F.max("_p._m").alias("_m")).filter(F.bit_count("_bits") >= F.col("_m")).select("_key", "_entry")
    candidates = pairs.repartition("_key").join(small_(entries), "_entry").groupBy("_key").agg(F.collect_list(F.struct("_entry", "_words")).alias("_near"))
    # Only the tokens go on to be compared.  Rows with equal keys are compared each by its own, so a key that two texts share does no harm.
    held = base.withColumn("_text", F.array_join(tokens(F.col("claim")), " "))
    score = lambda e: F.size(F.filter(e["_words"], lambda w: F.contains(F.col("_text"), w))) / F.size(e["_words"])
    scored = F.transform(F.col("_near"), lambda e: F.struct((-score(e)).alias("_s"), e["_entry"].alias("_entry")))
    # The greatest score; of equal ones the least entry.
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["_s"] <= -least)), 1, 1)
    out = held.join(candidates, "_key", "inner" if only_found else "left").select(*claims.columns, F.explode_outer(best).alias("_best"))
    out = out.filter("_best is not null") if only_found else out
    return out.select(*claims.columns, F.col("_best._entry").alias("entry"), (-F.col("_best._s")).alias("score"))
