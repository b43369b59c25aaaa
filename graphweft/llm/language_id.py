"""Language identification by words first, backing off to ever shorter character n-grams.

A text's score for a language is the mean, over its words, of the log frequency that the
language gives the word. A word the model doesn't know is scored by its longest character
n-grams that the model does know: those of ``orders[0]`` characters if there are any,
else one character fewer, and so on, averaged. Words have ``_`` put at both ends before
they are cut, so that beginnings and endings count as such.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, map_batches, prepare, quoted

#: Bounds of what is learned: labelled documents read, words and n-grams kept.
MAX_DOCS, MAX_WORDS, MAX_GRAMS = 6_000, 60_000, 40_000
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
_ROOM, _STEP = 300_000, 50_000  # unseen words a worker remembers at once, words scored in one step
_CHARS = 1 << 19  # characters of the texts whose words are in memory together; a longer text is alone


def held_out(id_col: Column, buckets: int, bucket: int) -> Column:
    """Whether crc32 of the id as text falls into the bucket that is never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % buckets == bucket


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams, its ends marked; single characters are its own only, as the mark alone says nothing."""
    w = f"_{word}_" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    orders: tuple[int, ...] = ORDERS

    def backoff(self, word: str) -> tuple[float, ...]:
        """Log frequencies of an unseen word; all equal if not even its letters are known."""
        for n in self.orders:
            known = [g for x in grams(word, n) if (g := self.grams.get(x))]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return (0.0,) * len(self.langs)


def bounded(df: DataFrame, key: Column, most: int) -> DataFrame:
    """Rows with the lowest hashes of ``key``, about ``most`` of them; all if there are no more."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, orders: tuple[int, ...] = ORDERS) -> LanguageModel:
    """Learn from a hash sample of about ``max_docs`` rows with neither text nor language null.

    Counting is distributed; the driver gets ``max_words`` + ``max_grams`` terms at most, with
    their counts in each language. Frequencies of n-grams are among those of their length.
    """
    rows = docs.select(quoted(text_col).alias("text"), quoted(lang_col).cast("string").alias("lang"), quoted(id_col).alias("id")).where("text is not null and lang is not null")

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.update((lang, w) for w in WORD.findall(text.lower()))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "term", "n"])

    def count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in orders:
                for g in grams(word, k):
                    found[lang, g] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "term", "n"])

    schema = "lang string, term string, n long"
    total = lambda df: df.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    words = checkpoint(total(map_batches(dealt(bounded(rows, F.col("id"), max_docs).select("text", "lang")), count_words, schema)))
    pieces = checkpoint(total(map_batches(words, count_grams, schema)))
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())

    def vectors(counts: DataFrame, most: int, kind: Column) -> dict[str, tuple[float, ...]]:
        """Log frequencies, among all terms of their kind, of the ``most`` commonest terms, in every language."""
        sizes = {(r.lang, r.kind): r.n for r in counts.groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}
        top = counts.groupBy("term").agg(F.sum("n").alias("all"), kind.alias("kind")).where(F.col("all") > 1).orderBy(F.desc("all"), "term").limit(most)
        by_term: dict[str, dict[str, int]] = {}
        kinds: dict[str, int] = {}
        for r in counts.join(F.broadcast(top), "term").toLocalIterator():
            by_term.setdefault(r.term, {})[r.lang], kinds[r.term] = r.n, r.kind
        return {t: tuple(float(np.log((c.get(x, 0) + 0.1) / (sizes.get((x, kinds[t]), 0) + 1))) for x in langs) for t, c in sorted(by_term.items())}

    return LanguageModel(langs, vectors(words, max_words, F.lit(0)), vectors(pieces, max_grams, F.length("term")), tuple(orders))


class Scorer:
    """Scores texts; keeps the vectors of words met so far, ``_ROOM`` at most."""

    def __init__(self, model: LanguageModel):
        self.model, self.k = model, len(model.langs)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {w: i for i, w in enumerate(self.model.words)}
        self.table = np.zeros((len(self.at) + _ROOM, max(1, self.k)))
        if self.at:
            self.table[: len(self.at)] = list(self.model.words.values())

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' rows in the table; each distinct word is looked up once."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.at) + len(distinct) > len(self.table):
            self.forget()
        where = np.empty(len(distinct), dtype=np.int64)
        for j, w in enumerate(distinct):
            i = self.at.get(w)
            if i is None:
                i = self.at[w] = len(self.at)
                self.table[i] = self.model.backoff(w)
            where[j] = i
        return where[np.asarray(coded.indices)]

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the words' vectors of each text, a step of words at a time."""
        out, flat = np.zeros((len(texts), max(1, self.k))), [w for t in texts for w in t]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for s in range(0, len(flat), _STEP):
            own = owner[s : s + _STEP]
            starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
            out[own[starts]] += np.add.reduceat(self.table_rows(flat[s : s + _STEP]), starts, axis=0)
        return out

    def table_rows(self, words: list[str]) -> np.ndarray:
        at = self.rows(words)  # may start a new table
        return self.table[at]

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share) of each text; as many texts are split into words at once as ``_CHARS`` allows."""
        out, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > _CHARS and i > start:
                out += self._group(texts[start:i])
                start, size = i, len(text or "")
        return out + self._group(texts[start:])

    def _group(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [WORD.findall((t or "").lower()) for t in texts]
        told = [bool(self.k) and any(c.isalpha() for w in words for c in w) for words in split]  # \w has number signs that are no letters
        out, known = [(UNDETERMINED, 0.0)] * len(texts), [i for i, ok in enumerate(told) if ok]
        if known:
            mean = self.totals([split[i] for i in known]) / np.array([[len(split[i])] for i in known])
            best = mean.argmax(axis=1)
            share = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(known, best.tolist(), share.tolist(), strict=True):
                out[i] = (self.model.langs[b], p)
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.batch([text])[0]


def _scorer(df: DataFrame, model: LanguageModel):
    prepare(df.sparkSession)
    shared, own = df.sparkSession.sparkContext.broadcast(model), {}

    def scorer() -> Scorer:
        if not own:
            own["scorer"] = Scorer(shared.value)
        return own["scorer"]

    return scorer


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep``, then lang_pred and score, for each row of ``docs``.

    ``score`` is the share of the best language in the exponentials of the mean scores,
    0 to 1. A text that is null, empty or without letters is ``und`` with score 0, as is
    every text if nothing was learned. Ties go to the language first by name. Repeated
    rows are scored alike; an empty table gives an empty result.
    """
    keep = keep or {}
    names = list(keep)
    source = docs.select(*[c.alias(k) for k, c in keep.items()], quoted(text_col).cast("string").alias("__text"))
    kinds = "".join(f"`{k}` {t}, " for k, t in source.dtypes[:-1])
    scorer = _scorer(docs, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scorer().batch(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return map_batches(dealt(source), run, f"{kinds}lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_gain: float = 1.02) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told.

    Rejected are texts that are null, empty or without letters and those that favour no
    language, scoring less than ``min_gain`` times what equal shares would give (a text of
    letters the model never met has exactly those). Repeated rows fare alike; an empty table
    gives an empty result; if nothing was learned every text goes.
    """
    least = min_gain / len(model.langs) if len(model.langs) > 1 else 0.0
    scorer, at = _scorer(docs, model), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scorer().batch(batch.column(at).to_pylist())
        return batch.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least for x in found], pa.bool_()))

    return map_batches(dealt(docs), run, docs.schema)
