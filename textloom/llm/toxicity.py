"""Toxicity of texts whose words may be disguised: restored by a noisy channel, then scored.

A disguised word is a lattice of what its characters may stand for; Viterbi finds the reading that is
likeliest under a character model of the corpus and the costs of the disguises; a logistic model
that was fitted to labelled texts scores the words of the restored text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, small, text_or_empty

# Letters that digits and signs stand for, signs that hide any letter, and signs between letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "§": "s"}
MASKS = "*#%"
BETWEEN = ".-_~'`’·/\\ \t"
#: Costs of the channel in nats: a sign for a letter, a masked letter, a dropped sign between letters, a dropped repeat
#: of two, a run of three or more, and a sign or a digit that only separates words.
SIGN, MASKED, DROPPED, DOUBLED, REPEATED, SEPARATES, DIGITS = 1.5, 1.0, 1.0, 2.0, 0.5, 0.5, 3.0
#: Symbols of the character model: the letters, any other letter, and what is no letter.
SYMBOLS, OTHER, GAP = 28, 26, 27
ORDER = 4
#: Weight of the shorter history in the character model.
BACKOFF = 5.0
#: Characters at each side of a suspect place that are decoded with it, in runs longer than twice that.
AROUND = 24
#: Different labelled texts of each class that the fit expects to read at most, and parts of words that the model knows.
MOST_FITTED, MOST_PARTS = 6_000, 4_096
#: A part of words is tried as evidence from this G-squared and this number of texts on.
LEAST_G2, LEAST_TEXTS = 10.0, 4
#: Lengths of word beginnings that are evidence beside whole words; different words of a text with a beginning that are told apart.
SHORTEST, LONGEST, STEPS = 3, 8, (2, 4)
#: Standard errors by which the share of toxic texts with a part is lowered when the part counts alone.
SURE = 3.0
#: Share of toxic texts among those with a part, from which on the part can count alone.
PURE = 0.99
#: Strength of the model's L2 penalty.
REGULAR = 1e-5
MOST_CACHED = 200_000

WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LEET) + MASKS)
_SUSPECT = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1|[^\W\d_][{re.escape(BETWEEN)}]+[^\W\d_]")
_DOUBLED, _RUN = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1+", re.S)
_MASKED = re.compile(rf"(?<=[^\W_])[{re.escape(MASKS)}]+(?=[^\W_])")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_EDGE = ".,;:?\"“”„«»[]{}"


@lru_cache(65_536)
def symbol(c: str) -> int:
    """Number of a character: of its base letter a-z, of any other letter, or of a gap."""
    base = unicodedata.normalize("NFD", c)[:1]
    return ord(base) - 97 if "a" <= base <= "z" else OTHER if c.isalpha() else GAP


_TABLE = np.array([symbol(chr(i).lower()[:1]) for i in range(0x250)], np.uint8)


def grams(text: str) -> Iterator[np.ndarray]:
    """Numbers of all runs of ORDER symbols of a text, gaps as one symbol and one at each end; long texts in parts."""
    rest = np.array([GAP], np.uint8)
    step = 1 << 20
    for at in range(0, len(text) + 1, step):
        part = text[at : at + step] + (" " if at + step > len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        symbols = np.concatenate([rest, np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER).astype(np.uint8)])
        kept = np.ones(len(symbols), bool)
        kept[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP)
        symbols = symbols[kept].astype(np.int64)
        if len(symbols) >= ORDER:
            yield sum(symbols[i : len(symbols) - ORDER + 1 + i] * SYMBOLS ** (ORDER - 1 - i) for i in range(ORDER))
        rest = symbols[-(ORDER - 1) :].astype(np.uint8)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities of a symbol after three, flat, from the counts over all texts; at most 28^4 counts reach the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SYMBOLS**ORDER, np.int64), [], 0
        for b in batches:
            for text in b.column(0):
                for numbers in grams(text.as_py() or ""):
                    held.append(numbers)
                    size += len(numbers)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=len(total))
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counts = np.zeros(SYMBOLS**ORDER)
    for r in docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["gram"]] = r["n"]
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the last symbol after the others, each history backed by the shorter one."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(1, ORDER + 1):
        table = counts.reshape(-1, SYMBOLS**k).sum(axis=0).reshape(-1, SYMBOLS)
        p = (table + BACKOFF * np.tile(p.reshape(-1, SYMBOLS), (len(table) // max(1, p.size // SYMBOLS), 1))) / (table.sum(axis=1, keepdims=True) + BACKOFF)
    return np.log(p).reshape(-1).astype(np.float32)


def options(c: str, run: int) -> list[tuple[str, float]]:
    """What a run of a character may stand for, with the channel's costs; a space ends a word."""
    if c.isalpha():
        return [(c, 0.0)] if run == 1 else [(c * 2, 0.0), (c, DOUBLED)] if run == 2 else [(c, REPEATED), (c * 2, REPEATED)]
    if c in LEET:
        return [(x * n, SIGN) for x in LEET[c] for n in (1, 2)[:run]] + [(" ", DIGITS if c.isdigit() else SEPARATES)]
    if c in BETWEEN:
        return [("", DROPPED), (" ", 0.0)]
    return [(" ", 0.0)]


def lattice(chunk: str, masked: dict[int, str] = {}) -> list[list[tuple[str, float]]]:
    """The readings of each run of equal characters; masked: letters that a mask at a place may hide."""
    out, i = [], 0
    while i < len(chunk):
        j = i
        while j < len(chunk) and chunk[j] == chunk[i]:
            j += 1
        if chunk[i] in MASKS:
            out += [[(x, MASKED) for x in masked.get(k, "")] + [(" ", SEPARATES), ("", DROPPED)] for k in range(i, j)]
        else:
            out.append(options(chunk[i], j - i))
        i = j
    return out


def restore(columns: list[list[tuple[str, float]]], model: memoryview) -> str:
    """The likeliest path of a lattice: Viterbi, whose states are the last three symbols."""
    histories = SYMBOLS ** (ORDER - 2)
    best = {SYMBOLS ** (ORDER - 1) - 1: (0.0, "")}
    for column in [*columns, [(" ", 0.0)]]:
        after: dict[int, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for out, price in column:
                now, total = state, cost + price
                for c in out:
                    s = symbol(c)
                    # Gaps beside each other are one.
                    if s != GAP or now % SYMBOLS != GAP:
                        total -= model[now * SYMBOLS + s]
                        now = now % histories * SYMBOLS + s
                # Of equally likely readings the one that is first by its letters.
                if now not in after or (total, text + out) < after[now]:
                    after[now] = (total, text + out)
        best = after
    return " ".join(min(best.values())[1].split())


def parts_of(word: str) -> list[str]:
    """What of a word is evidence: its beginnings, and all of it."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


def evidence(words: set[str]) -> list[str]:
    """Parts of a text's different words; those of 2 or 4 words and more also by that number."""
    counts: Counter[str] = Counter()
    for w in words:
        counts.update(parts_of(w))
    return [*counts, *(f"{p}#{n}" for p, c in counts.items() for n in STEPS if c >= n)]


#: A sign that stands for one of two letters makes the two one in skeletons.
_SKELETON = {**{c: x[0] for c, x in LEET.items()}, **{x[1]: x[0] for x in LEET.values() if len(x) > 1}}


_FOLDED = str.maketrans({**_SKELETON, **dict.fromkeys(BETWEEN)})


def folded(text: str) -> str:
    """The skeleton of a text without masks, faster."""
    return _RUN.sub(r"\1", text.translate(_FOLDED))


def skeleton(text: str) -> tuple[str, list[int]]:
    """Text with signs as letters, l as i, signs between letters dropped and repeats as one; and where each character stands.

    All readings of a lattice without masks have the skeleton of the lattice's text, but for gaps.
    """
    out, at = [], []
    for i, c in enumerate(text):
        if c in BETWEEN:
            continue
        c = _SKELETON.get(c, c)
        if not out or out[-1] != c or c in MASKS:
            out.append(c)
            at.append(i)
    return "".join(out), at


def hidden(key: str, cells: str) -> list[tuple[int, str]]:
    """(cell, letter) for the masks under which a key may lie in cells of a skeleton; at least half of its letters are in sight."""
    found: list[tuple[int, str]] = []

    def lay(k: int, c: int, under: tuple) -> None:
        if k == len(key):
            if under and 2 * len(under) <= len(key):
                found.extend(under)
        elif c < len(cells) and cells[c] in MASKS:
            lay(k + 1, c + 1, (*under, (c, key[k])))
            lay(k, c + 1, under)
        elif c < len(cells) and cells[c] == key[k]:
            lay(k + 1, c + 1, under)

    for c, x in enumerate(cells):
        # A word begins behind no letter.
        if x == key[0] and not (c and cells[c - 1].isalpha()):
            lay(0, c, ())
        elif x in MASKS:
            lay(1, c + 1, ((c, key[0]),))
    return found


class Scorer:
    """Scores texts one by one; keeps what it found for the chunks that it met."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], intercept: float, alone: dict[str, float]):
        self.model, self.weights, self.intercept, self.alone = memoryview(model.astype(np.float64)), weights, intercept, alone
        self.roots = {p.partition("#")[0] for p in weights}
        self.heads = {p[:SHORTEST] for p in self.roots}
        for_ = {p for p in self.roots if any(weights.get(f"{p}{x}", 0.0) > 0 for x in ("", *(f"#{n}" for n in STEPS)))}
        #: What tells words of evidence for toxicity: the skeletons of their parts.
        self.tells = {skeleton(p.rstrip("$"))[0] for p in for_} - {""}
        self.sizes = sorted({len(x) for x in self.tells})
        self.cache: dict[str, tuple] = {}

    def suspect(self, chunk: str) -> list[tuple[int, int, dict[int, str]]]:
        """(first, end, letters under masks) of the parts of a chunk that may be read as words the model knows."""
        if not self.tells:
            return []
        text, at = skeleton(chunk)
        # A word begins where the chunk does or behind a sign.
        starts = [i for i, k in enumerate(at) if not k or not chunk[k - 1].isalpha()]
        found, masked = [(at[i], at[i + size - 1] + 1) for i in starts for size in self.sizes if i + size <= len(at) and text[i : i + size] in self.tells], {}
        for m in _MASKED.finditer(chunk):
            lo = max(0, m.start() - LONGEST)
            cells, places = skeleton(chunk[lo : m.end() + LONGEST])
            under = [x for key in self.tells for x in hidden(key, cells)]
            for c, x in under:
                masked[lo + places[c]] = "".join(sorted({*masked.get(lo + places[c], ""), *("il" if x == "i" else x)}))
            if under:
                found.append((m.start(), m.end()))
        if not found or len(chunk) <= 4 * AROUND:
            return [(0, len(chunk), masked)] if found else []
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            a, b = max(0, a - AROUND), min(len(chunk), b + AROUND)
            if out and a <= out[-1][1] and b - out[-1][0] <= 8 * AROUND:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return [(a, b, {k - a: v for k, v in masked.items()}) for a, b in out]

    def read(self, chunk: str) -> list[str] | None:
        """Words of a chunk as restored; None where nothing in it can be disguised."""
        if not (ranges := self.suspect(chunk)):
            return None
        return [w for a, b, masked in ranges for w in WORD.findall(restore(lattice(chunk[a:b], masked), self.model))]

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk without spaces, restored where they are disguised."""
        if chunk.isalpha():
            # Letters alone are one word, disguised by repeats only.
            if _DOUBLED.search(chunk) and (text := folded(chunk)) and any(text[:k] in self.tells for k in self.sizes):
                return self.read(chunk) or [chunk]
            return [chunk]
        core = chunk.strip(_EDGE)
        if core.isalpha() and not _DOUBLED.search(core):
            return [core]
        found = self.read(core) if _SUSPECT.search(core.rstrip("!")) else None
        if found is None:
            return WORD.findall(chunk)
        # Words that signs between letters may separate are words of the text in any case.
        return found + [w for w in WORD.findall(chunk) if w not in found] if any(c in BETWEEN for c in core) else found

    def known(self, words: list[str]) -> tuple:
        """((word, its parts that the model knows), ...)."""
        pairs = [(w, tuple(p for p in parts_of(w) if p in self.roots)) for w in words if w[:SHORTEST] in self.heads or len(w) < SHORTEST]
        return tuple(x for x in pairs if x[1])

    def score(self, text: str) -> float:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
        met: dict[str, tuple] = {}
        cache = self.cache
        for chunk in set(text.split()):
            if (found := cache.get(chunk)) is None:
                found = self.known(self.words(chunk))
                if len(cache) > MOST_CACHED:
                    cache.clear()
                if len(chunk) <= 64:
                    cache[chunk] = found
            if found:
                met.update(found)
        for m in _SPACED.finditer(text):
            met.update(self.known(self.read(m.group()) or []))
        counts = Counter(p for parts in met.values() for p in parts)
        found = [x for p, c in counts.items() for x in (p, *(f"{p}#{n}" for n in STEPS if c >= n)) if x in self.weights]
        z = self.intercept + math.fsum(self.weights[x] for x in found)
        together = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
        return max(together, max((self.alone.get(x, 0.0) for x in found), default=0.0))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


EVIDENCE = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("least", T.LongType())])


@F.pandas_udf(EVIDENCE)
def _evidence(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = WORD.findall(unicodedata.normalize("NFKC", text).lower())
        # The least hash of three words in a row is one that near copies share, as a rule.
        least = min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))))
        rows.append((evidence(set(words)), least - (1 << 63)))
    return pd.DataFrame(rows, columns=["parts", "least"])


def sure_share(k: float, n: float) -> float:
    """Lower end of the Wilson interval of k of n."""
    p, z = k / n, SURE * SURE / n
    return (p + z / 2 - math.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_FITTED) -> tuple[dict[str, float], float, dict[str, float]]:
    """(weights of parts of words, intercept) of a logistic model, and how surely each part alone marks toxic texts.

    Learns from the rows that are not held out and whose label is not null, each different text once (with the largest
    of its labels) and, where a class has more than `most`, a hash-random part of that expected size, less near copies.  Evidence are
    beginnings of words and whole words that stand in one class's texts more often than in the other's; all counts and the
    regression run on Spark, and only the weights of at most MOST_PARTS parts reach the driver.  With texts of one class only, or none,
    there are no weights and the score of every text is that class's share, 0 without any.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.md5(F.col(text_col)).alias("_k"), F.col(text_col).alias("_t")).filter("_t is not null")
    # Digests stand for the texts in the shuffles; only the texts of the sample are read again.
    each = cut(texts.select("_id", "_k").join(marked, "_id").groupBy("_k").agg(F.max("_y").alias("_y")))
    sizes = {r["_y"]: r["n"] for r in each.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}, 30.0 if toxic else -30.0, {}
    share = F.when(F.col("_y") == 1, F.lit(most / toxic)).otherwise(F.lit(most / clean))
    chosen = cut(each.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < share * float(1 << 30)))
    read = texts.join(small(chosen, chosen.count()), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t"))
    scanned = read.select("_k", F.col("_y").cast("double").alias("_y"), _evidence("_t").alias("_e")).select("_k", "_y", "_e.parts", "_e.least")
    sample = cut(scanned.groupBy("least").agg(F.min(F.struct("_k", "_y", F.col("parts").alias("_parts"))).alias("_r")).select("_r._y", "_r._parts"))
    n, m = sample.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not n or not m or m == n:
        return {}, math.log((toxic + 0.5) / (clean + 0.5)), {}
    counts = sample.select("_y", F.explode("_parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("k")).filter(F.col("n") >= LEAST_TEXTS)
    p = F.lit(m / n)
    gain = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)
    clean_k = F.col("n") - F.col("k")
    measured = counts.withColumn("g", 2 * (gain(F.col("k"), F.col("n") * p) + gain(clean_k, F.col("n") * (1 - p)))).filter(F.col("g") >= LEAST_G2)
    best = measured.orderBy(F.col("g").desc(), "part").limit(MOST_PARTS).collect()
    if not best:
        return {}, math.log((toxic + 0.5) / (clean + 0.5)), {}
    parts = [r["part"] for r in best]
    # The sample may hold the classes in other shares than the corpus; the weights of its rows undo that.
    of_toxic, of_clean = max(1.0, toxic / most), max(1.0, clean / most)
    shares = [(r["part"], r["k"], r["k"] + (r["n"] - r["k"]) * of_clean / of_toxic) for r in best]
    alone = {part: sure_share(k, size) for part, k, size in shares if k >= PURE * size}
    weighed = sample.withColumn("_weight", F.when(F.col("_y") == 1, F.lit(of_toxic)).otherwise(F.lit(of_clean)))
    vectors = CountVectorizerModel.from_vocabulary(parts, "_parts", "_x", binary=True).transform(weighed)
    found = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", regParam=REGULAR, maxIter=60, standardization=False).fit(vectors.select("_x", "_y", "_weight"))
    return dict(zip(parts, found.coefficients.toArray().tolist())), float(found.intercept), alone


def scores(docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of whole texts; model: a broadcast of (character model, and what fit() gives), whose size is bounded."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*model.value)
        for texts in batches:
            yield texts.map(scorer.score)

    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(text_or_empty(F.col(text_col))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The character model is counted over all texts, the logistic model fitted as in fit().  Each text, whole, is
    cut at white space.  A chunk with signs or digits for letters, masked letters, signs between letters or repeated letters, and a
    run of three and more single characters, is decoded if it can be read as a word the model
    has evidence for (a comparison of skeletons, which loses none); all other words are read as they stand.  Letters spaced out in groups
    of two and more are not joined, and of a masked word half the letters must be in sight.  The score is that of the restored
    words together, or that of one that alone is surer: the lower end of the interval of its share of toxic texts.

    A null or empty text, like one without evidence, gets the score of the intercept.  Rows that repeat are scored alike;
    a null identifier is held in, and its label is not joined.  An empty table gives no rows.
    """
    weights, intercept, alone = fit(docs, labels, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast((character_model(docs, text_col), weights, intercept, alone))
    return scores(docs, model, id_col, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
