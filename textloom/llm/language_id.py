"""Language identification: script ranges, per-word scores and Viterbi labels."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The first code point of script ranges, and their names.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x3040, "kana"), (0x3130, "hangul"), (0x31F0, "kana"),
    (0x3400, "han"), (0xA000, "yi"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE80, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language that the fit expects to read at most.
MOST_FITTED = 1200
#: Cost of a change of language between two words, in nats.
SWITCH = 8.0
#: Words whose scores a worker keeps; words scored together.
MOST_CACHED, BLOCK = 200_000, 200_000
SMOOTH = 2.0


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


class Model:
    """Character trigram models of several languages with back-off, and the scripts each is written in."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        """rows: (lang, kind, key, count), where kind is gram (1 to 3 characters) or script (words in it)."""
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        k = len(self.langs)
        self.counts: dict[str, np.ndarray] = {}
        seen: dict[str, np.ndarray] = {}
        size = np.zeros(k)
        for lang, kind, key, n in rows:
            (self.counts if kind == "gram" else seen).setdefault(key, np.zeros(k))[at[lang]] += n
            if kind == "script":
                size[at[lang]] += n
        # A language is a candidate for a word if 1 % of its fitted words are in the word's script.
        self.masks = {s: np.where(c >= 0.01 * size, 0.0, -60.0) for s, c in seen.items()}
        self.masks = {s: m for s, m in self.masks.items() if (m == 0).any()}
        self.total = sum(c for g, c in self.counts.items() if len(g) == 1) if rows else np.zeros(k)
        self.letters = sum(len(g) == 1 for g in self.counts) + 1
        self.prior = np.log((size + 1) / (size.sum() + k)) if k else np.zeros(0)
        self.none = np.zeros(k)
        # Log-probabilities of the character runs met so far, and the row of each.
        self._rows: dict[int, int] = {}
        self._table = np.zeros((1024, k))

    def gram(self, g: str) -> np.ndarray:
        """Log-probability of the last character of g after those before it, for each language."""
        get = lambda x: self.counts.get(x, self.none)
        p = (get(g[-1]) + 0.5) / (self.total + 0.5 * self.letters)
        if len(g) > 1:
            p = (get(g[-2:]) + SMOOTH * p) / (get(g[-2]) + SMOOTH)
        if len(g) > 2:
            p = (get(g) + SMOOTH * p) / (get(g[:2]) + SMOOTH)
        return np.log(p)

    def _row(self, key: int) -> int:
        """Row of a run of two or three characters, given as their code points in 21 bits each."""
        if (at := self._rows.get(key)) is None:
            at = len(self._rows)
            if at >= len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[at] = self.gram("".join(chr(key >> n & 0x1FFFFF) for n in (42, 21, 0) if key >> n))
            self._rows[key] = at
        return at

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): the log-probability of each word less that of its best language, and its script's mask."""
        if len(self._rows) > MOST_CACHED:
            self._rows.clear()
        points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 2 for w in words])
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]])
        # The run that ends at each character but a word's first; the second has one character before it.
        at = np.delete(np.arange(len(points)), first)
        third = points[at - 2] << 42
        starts = first - np.arange(len(first))
        third[starts] = 0
        keys, inverse = np.unique(third | points[at - 1] << 21 | points[at], return_inverse=True)
        rows = np.array([self._row(x) for x in keys.tolist()])
        out = np.add.reduceat(self._table[rows][inverse], starts, axis=0)
        # What one word says is bounded, so that one odd name can't outweigh a sentence.
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, -25.0, out=out)
        kinds, kind = np.unique(np.searchsorted(_STARTS, points[first + 1], "right") - 1, return_inverse=True)
        masks = np.array([self.masks.get(SCRIPTS[i][1], self.none) for i in kinds])
        return out + masks[kind]


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        return at


class Scorer:
    """Numbers words and scores each different one once, many at a time."""

    def __init__(self, model: Model):
        self.model, self.ids, self.scored = model, Numbers(), 0
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        # Words that are scored together; the more languages, the fewer.
        self.together = max(256, 200_000 // max(1, len(model.langs)))

    def ids_of(self, words: list[str]) -> list[int]:
        return list(map(self.ids.__getitem__, words))

    def score(self) -> None:
        """Fill the rows of words that are new."""
        new = list(islice(reversed(self.ids), len(self.ids) - self.scored))[::-1]
        if (short := len(self.ids) - len(self.table)) > 0:
            self.table = np.concatenate([self.table, np.zeros((max(short, len(self.table)), self.table.shape[1]), np.float32)])
        for i in range(0, len(new), self.together):
            some = new[i : i + self.together]
            self.table[self.scored : self.scored + len(some)] = self.model.scores(some)
            self.scored += len(some)

    def trim(self) -> None:
        if len(self.ids) > MOST_CACHED:
            self.ids.clear()
            self.scored = 0


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts are runs of rows of scores (starts, sizes; no empty ones)."""
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    if k < 2 or not len(sizes):
        return labels
    s = scores.astype(np.float64)
    s[starts] += prior
    text = np.repeat(np.arange(len(sizes)), sizes)
    best = np.add.reduceat(s, starts, axis=0).argmax(1)
    # A text keeps its best label throughout if no run of words gains more than half a switch by
    # another label: a path with k runs in other labels pays k - 1 switches at least, and with
    # k = 1 and none it is another label throughout, which is not better.
    against = s - s[np.arange(n), best[text]][:, None]
    run = np.cumsum(against, axis=0)
    first = run[starts] - against[starts]
    run -= first[text]
    low = run.copy()
    low[starts] = np.minimum(low[starts], 0)
    low = np.concatenate([np.zeros((1, k)), low[:-1]])
    low[starts] = 0
    wide = np.abs(run).max() * 2 + 1
    shift = (np.arange(len(sizes), dtype=np.float64) * wide)[text][:, None]
    low = np.minimum.accumulate(low - shift, axis=0) + shift
    gain = np.maximum.reduceat(run - low, starts, axis=0).max(1)
    labels[:] = best[text]
    mixed = np.flatnonzero(gain > switch / 2 - 1e-6)
    if len(mixed):
        _decode(s, starts[mixed], sizes[mixed], switch, labels)
    return labels


def _decode(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float, labels: np.ndarray) -> None:
    """Viterbi over all given texts side by side, longest first; fills their labels."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest, k = int(sizes[0]), s.shape[1]
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    have = s[starts].copy()
    came: list[np.ndarray] = [np.empty(0)]
    for t in range(1, longest):
        a = active[t]
        now = have[:a]
        top = now.argmax(1)
        jump = now[np.arange(a), top][:, None] - switch
        take = jump > now
        came.append(np.where(take, top[:, None], np.arange(k)).astype(np.int8 if k < 128 else np.int16))
        have[:a] = np.where(take, jump, now) + s[starts[:a] + t]
    state = have.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        labels[starts[:a] + t] = state[:a]
        if t:
            state[:a] = came[t][np.arange(a), state[:a]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_FITTED) -> Model:
    """Model of the labelled documents that are not held out (crc32 of the identifier as text, mod 5, is not 0).

    The fit reads a hash-random sample that is expected to hold `most` documents of each
    language at most; that bound, and no table size, limits what the driver sees.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).filter(F.col("_lang").isNotNull() & (F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 5, F.lit(1)) != 0))
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    if not counts:
        return Model([])
    part = F.coalesce(*[F.when(F.col("_lang") == lang, F.lit(min(1.0, most / n))) for lang, n in sorted(counts.items())])
    sample = known.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < part * float(1 << 30)).select("_lang", "_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b["_lang"], b["_text"]):
                if text:
                    found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            rows = []
            for lang, words in found.items():
                grams: Counter = Counter()
                scripts: Counter = Counter()
                for word, n in words.items():
                    scripts[script_of(word)] += n
                    w = f"^{word}$"
                    for m in (1, 2, 3):
                        for j in range(len(w) - m + 1):
                            grams[w[j : j + m]] += n
                rows += [(lang, "gram", g, n) for g, n in grams.items()] + [(lang, "script", x, n) for x, n in scripts.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    # At most as many rows as the sample's alphabets have runs of three characters.
    found = sample.mapInPandas(count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in found.collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans array<struct<lang, first, words>>.

    Words are runs of letters of the whole text.  Only languages written in a word's script are
    candidates for it.  The Viterbi path over the words' trigram scores, which pays `switch` for
    each change of language, labels every word; lang_pred has most words (ties: the first by code
    point), score is its part of the words.

    Null texts, texts without a letter, and all texts under a model without languages give und, score 0 and no spans.  Repeated
    rows are labelled one by one.  An empty table gives no rows.
    """

    label = _labeller(model, switch)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(label, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def _labeller(model: Model, switch: float):
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            texts = b["text"].tolist()
            done = 0
            while done < len(texts):
                ids: list[int] = []
                sizes = []
                begin = done
                while done < len(texts) and len(ids) < BLOCK:
                    found = WORD.findall(texts[done].lower()) if texts[done] else []
                    if found and not any(map(str.isalpha, texts[done])):
                        found = []
                    if model.langs:
                        ids.extend(scorer.ids_of(found))
                    sizes.append(len(found) if model.langs else 0)
                    done += 1
                scorer.score()
                yield _report(scorer, b["doc_id"].iloc[begin:done], np.array(ids, np.int64), np.array(sizes, np.int64), switch)
                scorer.trim()

    return label


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs without the rows that have no language (und) or none with least_score of the words; all columns unchanged.

    So null and empty texts and texts without letters go.  Repeated rows stay or go together; an empty table gives no rows.
    """
    label = _labeller(model, switch)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = pd.DataFrame({"doc_id": np.arange(b.num_rows), "text": b.column(text_col).to_pandas()})
            found = [x for x in label(iter([frame]))]
            good = np.concatenate([((x["lang_pred"] != "und") & (x["score"] >= least_score)).to_numpy() for x in found]) if found else np.zeros(0, bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def _report(scorer: Scorer, doc_ids: pd.Series, ids: np.ndarray, sizes: np.ndarray, switch: float) -> pd.DataFrame:
    langs = scorer.model.langs
    pred, score, spans = ["und"] * len(sizes), [0.0] * len(sizes), [[] for _ in sizes]
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        labels = viterbi(scorer.table[ids], starts, sizes[full], scorer.model.prior, switch)
        turns = np.flatnonzero(np.diff(labels, prepend=-1) != 0)
        turns = np.union1d(turns, starts)
        ends = np.append(turns[1:], len(labels))
        text = np.searchsorted(starts, turns, side="right") - 1
        words = np.zeros((len(full), len(langs)), np.int64)
        np.add.at(words, (text, labels[turns]), ends - turns)
        most = words.argmax(1)
        for i, (at, m, row) in enumerate(zip(full.tolist(), most.tolist(), words)):
            pred[at], score[at] = langs[m], float(row[m] / sizes[at])
        for x, a, e, la in zip(text.tolist(), turns.tolist(), ends.tolist(), labels[turns].tolist()):
            spans[full[x]].append({"lang": langs[la], "first": int(a - starts[x]), "words": int(e - a)})
    out = pd.DataFrame({"doc_id": doc_ids.to_numpy(), "lang_pred": pred, "score": score})
    out["spans"] = spans
    out["doc_id"] = doc_ids.to_numpy()
    return out


def held_out(id_col: str = "doc_id"):
    """crc32 of the identifier as text, mod 5, is 0; false for a null identifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
