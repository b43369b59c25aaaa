"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words, hashed to ``1 << BITS`` buckets. The score is the logistic
function of a bias, a weight for each term and, for each couple of terms, the product of
their factor vectors, so that a couple (an insult and the mention of a group, say) can
weigh more, or less, than its two terms.

Terms come to the machine in two ways: alone, if texts that hold them are toxic more or less
often than others, and as couples, if texts that hold both are so more or less often than the
two let expect. So words that say nothing alone and much together are not lost before the
machine sees them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, dealt, map_batches, prepare, quoted
from .language_id import bounded

#: Bounds of what is learned: labelled rows read, terms kept alone, and terms whose couples are looked at and couples kept.
MAX_ROWS, MAX_TERMS, SCREENED, MAX_COUPLES = 20_000, 1_024, 1_024, 256
#: What a kept term must show: texts that hold it, and standard errors from the mean; and a couple: the surprise in nats, beyond chance among half a million couples, and the shift.
MIN_DF, MIN_Z, MIN_SURPRISE, MIN_SHIFT = 5, 4.0, 17.0, 0.15
BITS, FACTORS, SEED, STEPS = 20, 8, 7, 1_200
WORD = re.compile(r"[^\W\d_]+")
_ROOM = 300_000


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) & ((1 << BITS) - 1)


@dataclass(frozen=True)
class FactorizationMachine:
    """Terms (hash buckets) with a weight and a factor vector each."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, columns: list[int]) -> float:
        v = self.factors[columns]
        return float(self.bias + self.weights[columns].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v * v).sum(axis=0)).sum())

    def score(self, columns: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(columns), -40, 40))))

    def centred(self, rows: list[list[int]], labels: np.ndarray, false_alarm: float = 2.0) -> FactorizationMachine:
        """The machine with its bias moved so that 0.5 parts the rows best.

        A row labelled 0 above the cut costs ``false_alarm`` rows labelled 1 below it; of
        cuts that cost the same the one in the widest gap is taken, at its middle.
        """
        z, y = np.array([self.logit(r) for r in rows]), np.asarray(labels)
        if not (y == 1).any() or not (y == 0).any():
            return self
        order = np.argsort(z)
        z, y = z[order], y[order]
        below_1, above_0 = np.cumsum(y == 1), (y == 0).sum() - np.cumsum(y == 0)
        cost, gap = (below_1 + false_alarm * above_0)[:-1], np.diff(z)
        best = np.nonzero((cost == cost[gap > 0].min()) & (gap > 0))[0] if (gap > 0).any() else []
        if not len(best):
            return self
        at = best[gap[best].argmax()]
        return replace(self, bias=self.bias - float(z[at] + z[at + 1]) / 2)


def couples(x: np.ndarray, labels: np.ndarray, most: int = MAX_COUPLES) -> list[tuple[int, int]]:
    """Couples of columns of ``x`` (rows by terms, 0 or 1) whose rows are labelled 1 more or less often than their two terms let expect.

    What is expected adds the log odds of the two. The surprise is the binomial tail's
    exponent; the most surprising come first.
    """
    y = np.asarray(labels, dtype=np.float32)
    n_rows, n_terms = x.shape
    together, hits = np.zeros((n_terms, n_terms), np.float32), np.zeros((n_terms, n_terms), np.float32)
    for i in range(0, n_rows, 4096):
        part = x[i : i + 4096].astype(np.float32)
        together += part.T @ part
        toxic = part[y[i : i + 4096] == 1]
        hits += toxic.T @ toxic
    odds = lambda h, n: np.log((h + 0.5) / (n - h + 0.5))
    alone = odds(np.diag(hits), np.diag(together))
    expected = 1 / (1 + np.exp(-np.clip(alone[:, None] + alone[None, :] - odds(y.sum(), n_rows), -12, 12)))
    seen = np.clip(hits / np.maximum(together, 1), 1e-6, 1 - 1e-6)
    surprise = together * (seen * np.log(seen / expected) + (1 - seen) * np.log((1 - seen) / (1 - expected)))
    a, b = np.nonzero(np.triu((together >= MIN_DF) & (surprise >= MIN_SURPRISE) & (np.abs(seen - expected) >= MIN_SHIFT), 1))
    order = np.lexsort((b, a, -surprise[a, b]))[:most]
    return list(zip(a[order].tolist(), b[order].tolist(), strict=True))


def train(rows: list[list[int]], labels: np.ndarray, n_terms: int, epochs: int = 60, rate: float = 0.2, l2: float = 5e-5, l2_factors: float = 1e-3, positive: float = 3.0, batch: int = 256, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors that fit rows of distinct columns, by AdaGrad; a row labelled 1 weighs ``positive`` rows labelled 0. Few rows are gone through more often, for ``STEPS`` steps at least."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), n_terms), dtype=np.uint8)
    for i, columns in enumerate(rows):
        x[i, columns] = 1
    y = np.asarray(labels, dtype=np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    b, w, v = float(np.log(share / (1 - share))), np.zeros(n_terms, np.float32), rng.normal(0, 0.05, (n_terms, FACTORS)).astype(np.float32)
    gb, gw, gv = 1e-6, np.full(n_terms, 1e-6, np.float32), np.full((n_terms, FACTORS), 1e-6, np.float32)
    for _ in range(max(epochs, -(-STEPS // max(1, -(-len(rows) // batch))))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            part = order[start : start + batch]
            xb = x[part].astype(np.float32)
            sums = xb @ v
            z = b + xb @ w + 0.5 * ((sums * sums) - xb @ (v * v)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) * (1 + (positive - 1) * y[part]) / len(part)
            db, dw = float(error.sum()), xb.T @ error + l2 * w
            dv = xb.T @ (error[:, None] * sums) - (xb.T @ error)[:, None] * v + l2_factors * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            b, w, v = b - rate * db / gb**0.5, w - rate * dw / np.sqrt(gw), v - 0.3 * rate * dv / np.sqrt(gv)
    return b, w, v


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    """Learn from a hash sample of about ``max_rows`` rows of ``labels`` (id, 0/1; others and nulls ignored) and their texts.

    Equal texts of one label count once. The sample's ids are broadcast, its size being
    bounded; terms are counted in Spark. The driver gets the chosen terms and, for each
    sampled row, those it holds.
    """
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sample = bounded(known, F.col("id"), max_rows)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(sample), "id").select("y", "text").dropDuplicates()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [sorted({bucket(w) for w in set(WORD.findall(t.lower()))}) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["y", "terms"])

    features = checkpoint(map_batches(joined, hashed, "y int, terms array<int>"))
    n, positive = features.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return FactorizationMachine({}, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    p = min(max(positive / n, 1e-3), 1 - 1e-3)
    z = F.abs(F.col("hits") / F.col("n") - p) / F.sqrt(F.lit(p * (1 - p)) / F.col("n"))
    counted = checkpoint(features.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).where(F.col("n") >= MIN_DF).withColumn("z", z))
    alone = [r.term for r in counted.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(max_terms).collect()]
    screened = [r.term for r in counted.where(F.col("hits") >= MIN_DF).orderBy(F.desc("hits"), "term").limit(SCREENED).collect()]
    candidates = {t: i for i, t in enumerate(dict.fromkeys([*alone, *screened]))}
    held = F.array_intersect("terms", F.array(*[F.lit(t) for t in candidates]).cast("array<int>"))
    rows = [([candidates[t] for t in r.held], r.y) for r in features.select("y", held.alias("held")).toLocalIterator()]
    rows.sort()
    labels_ = np.array([y for _, y in rows])
    x = np.zeros((len(rows), len(candidates)), dtype=np.uint8)
    for i, (columns, _) in enumerate(rows):
        x[i, columns] = 1
    place = np.array([candidates[t] for t in screened], dtype=np.int64)
    chosen = sorted({candidates[t] for t in alone} | {int(place[i]) for c in couples(x[:, place], labels_) for i in c})
    at = {c: i for i, c in enumerate(chosen)}
    kept = [[at[c] for c in columns if c in at] for columns, _ in rows]
    names = list(candidates)
    b, w, v = train(kept, labels_, len(chosen))
    return FactorizationMachine({names[c]: i for c, i in at.items()}, b, w, v).centred(kept, labels_)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", keep: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns ``keep``, then score (0 to 1) and predicted (1 from ``threshold`` on), for each row.

    Texts that are null, empty or without any term the model knows get the score of the
    bias alone. Whole texts are read; repeated rows get equal scores; an empty table gives
    an empty result.
    """
    keep = keep or {}
    names = list(keep)
    source = docs.select(*[c.alias(k) for k, c in keep.items()], quoted(text_col).cast("string").alias("__text"))
    kinds = "".join(f"`{k}` {t}, " for k, t in source.dtypes[:-1])
    prepare(docs.sparkSession)
    shared, memo = docs.sparkSession.sparkContext.broadcast(model), {}

    def one(text: str | None) -> float:
        m, columns = shared.value, set()
        for w in set(WORD.findall((text or "").lower())):
            c = memo.get(w)
            if c is None:
                if len(memo) >= _ROOM:
                    memo.clear()
                c = memo[w] = m.terms.get(bucket(w), -1)
            if c >= 0:
                columns.add(c)
        return m.score(sorted(columns))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [one(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    return map_batches(dealt(source), run, f"{kinds}score double, predicted int")
