"""Fill-in-the-middle examples: texts cut at token boundaries and put together anew."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from textloom.llm.common import text_or_empty

# The marks before the three parts, and white space.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = r"\x20\x09-\x0D"
#: The same tokens as [space]*[other]+|[space]+; possessive, as giving characters back never helps.
TOKEN = f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"
#: Code points that are tokenized at a time, up to the next end of a token; only the offsets are kept.
PIECE = 1 << 16
_END = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of a text that begin and end where tokens do; longer than size only where a token is."""
    at = 0
    while at < len(text):
        found = _END.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        yield at, stop
        at = stop


def token_ends(split: pre_tokenizers.PreTokenizer, text: str, size: int = PIECE) -> np.ndarray:
    """Code-point offsets at which the tokens of a text end."""
    found = [np.fromiter((end for _, (_, end) in split.pre_tokenize_str(text[a:b])), np.int64) + a for a, b in pieces(text, size)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


CUTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


@F.pandas_udf(CUTS)
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    # One Split for each worker; isolated matches are the tokens, and nothing lies between them.
    split = pre_tokenizers.Split(Regex(TOKEN), behavior="isolated")
    for texts, one, two in batches:
        rows = []
        for text, x, y in zip(texts, one, two):
            ends = token_ends(split, text)
            # Rank 0 is the beginning of the text.
            places = [0 if not r else int(ends[r - 1]) for r in (x % (len(ends) + 1), y % (len(ends) + 1))]
            rows.append((len(ends), min(places), max(places)))
        yield pd.DataFrame(rows, columns=["n", "first", "last"])


def _draws(id_: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n tokens, each white space and the other characters behind it, by the Split
    pre-tokenizer of the tokenizers library: its isolated matches give code-point offsets, their
    number is n, and the offsets at two ranks drawn from the identifier cut the text into prefix,
    middle and suffix.  `rate` of 100 texts are rebuilt; of these `spm` of 100 as suffix, prefix,
    middle (spm), the others as prefix, suffix, middle (psm), each part behind its mark.  The draws
    come from a digest of seed and identifier, so reruns and every partitioning agree.

    plain texts (output is the text, prefix_chars and middle_chars null) are those not drawn, empty
    ones, and those that contain a mark.  A null text counts as empty; a null identifier draws like an empty
    string; repeated rows are rebuilt alike.  An empty table gives no rows.
    """
    text = text_or_empty(F.col(text_col))
    one, two, three, four = _draws(F.col(id_col), seed)
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), three.alias("_h3"), four.alias("_h4"), _cuts(text, one, two).alias("_c"))
    plain = (F.col("_t") == "") | F.contains("_t", F.lit(PREFIX)) | F.contains("_t", F.lit(SUFFIX)) | F.contains("_t", F.lit(MIDDLE)) | (F.col("_h3") % 100 >= rate)
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm"))
    part = lambda begin, size: F.substr(F.col("_t"), begin + F.lit(1), size)
    first, last = F.col("_c.first"), F.col("_c.last")
    prefix, middle, suffix = part(F.lit(0), first), part(first, last - first), part(last, F.length("_t"))
    output = (
        F.when(F.col("form") == "plain", F.col("_t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    rebuilt = F.col("form") != "plain"
    return formed.select("doc_id", F.col("_c.n").alias("n"), "form", F.when(rebuilt, first.cast("long")).alias("prefix_chars"), F.when(rebuilt, (last - first).cast("long")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of fill_middle was made from; null for a null output or form.

    Rebuilt texts hold no marks of their own, so the first place of each mark is the one that was put there.
    """
    after = lambda s, mark: F.substr(s, F.instr(s, mark) + F.lit(len(mark)), F.length(s))
    before = lambda s, mark: F.substr(s, F.lit(1), F.instr(s, mark) - F.lit(1))
    middle = after(output, MIDDLE)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
