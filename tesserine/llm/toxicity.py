"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a run of letters, lower-cased; its features are the word and its
first four, five and six letters, so that inflected forms share evidence. The
log-odds of a feature between toxic and clean training texts are shrunk by a
Dirichlet prior in proportion to the feature's overall rate. One linear scan
per text finds every maximal segment of positive score; segment scores are
turned into extreme-value tail probabilities, fitted on the best segments of
clean training texts, and a document's score is a logistic function of the
best and the summed evidence.

Training reads at most ``SAMPLE`` labelled documents, the ones with the
smallest hash of doc_id; two thirds of them give the log-odds and the rest the
calibration. The model keeps at most ``MODEL`` features.

Defined cases: null or empty texts have no token and get the score of no
evidence; a doc_id labelled more than once counts as toxic if any label says
so; null labels and null doc_ids are not trained on; without labelled rows of
both kinds every score is 0; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frame, materialize, rows_frame, small_batches, table, text_or_empty

SAMPLE, MODEL, PRIOR, LEAST, SURE = 20_000, 1 << 16, 4.0, 5, 5.0
#: What a token without evidence costs a segment, and the bounds of a token's score.
GAP, LOW, HIGH = 0.05, -0.5, 6.0
SIGNIFICANT = 0.01
TOKEN = re.compile(r"[^\W\d_]+")
CACHE = 300_000


def features(word: str) -> list[str]:
    return [word] + ["^" + word[:k] for k in (6, 5, 4) if len(word) > k]


def segments(scores: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a sparse score sequence.

    ``scores`` holds the tokens with evidence in order; every other token
    counts -gap. Each candidate points at the nearest one before it that starts
    from a lower sum. What a search passes over, later ones never see again, so
    the steps are linear in the tokens.
    """
    found: list[list[float]] = []  # first, last, sum before, sum after
    lower: list[int] = []
    total, at = 0.0, -1
    for i, s in scores:
        total -= gap * (i - at - 1)
        at = i
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i, before, total]
        j = len(found) - 1
        while j >= 0:
            if found[j][2] >= new[2]:
                j = lower[j]
                continue
            if found[j][3] >= new[3]:
                break
            new[0], new[2] = found[j][0], found[j][2]
            after = lower[j]
            del found[j:], lower[j:]
            j = after
        found.append(new)
        lower.append(j)
    return [(int(a), int(z), end - start) for a, z, start, end in found]


@dataclass
class Model:
    odds: dict[str, float]
    location: float = 0.0
    scale: float = 1.0
    weights: tuple[float, ...] = (-30.0, 0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def word(self, w: str) -> float:
        known = [self.odds[f] for f in features(w) if f in self.odds]
        return max(known, key=abs) if known else 0.0

    def tokens(self, text: str) -> tuple[list[tuple[int, float]], int]:
        words = TOKEN.findall(text.lower())
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.word(w)
        return [(i, s) for i, w in enumerate(words) if (s := cache[w])], len(words)

    def surprise(self, score: float, n: int) -> float:
        """-log10 of the chance that clean text of n tokens holds a segment of this score."""
        z = (score - self.location) / self.scale - math.log(max(n, 1))
        return z / math.log(10) if z > 30 else -math.log10(max(-math.expm1(-math.exp(-z)), 1e-300))

    def evidence(self, text: str) -> tuple[float, float]:
        hits, n = self.tokens(text)
        told = [self.surprise(s, n) for _, _, s in segments(hits)]
        return max(told, default=0.0), sum(t for t in told if t > -math.log10(SIGNIFICANT))

    def score(self, text: str) -> float:
        best, total = self.evidence(text)
        z = self.weights[0] + self.weights[1] * math.log1p(best) + self.weights[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, part of the training sample; part 2 calibrates."""
    known = (
        labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).cast("int"))
    )
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")  # sample rows at most


def log_odds(sample: DataFrame, most: int = MODEL) -> dict[str, float]:
    """Features with sure log-odds, from the frequencies over distinct texts of both classes."""
    sample = sample.select("text", "toxic").distinct()

    schema = "feature string, clean long, toxic long"

    def counted(batches):
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for w in {x for w in set(TOKEN.findall(text.lower())) for x in features(w)}:
                    rows.setdefault(w, [0, 0])[1 if toxic else 0] += 1
            yield rows_frame([(w, c, t) for w, (c, t) in rows.items()], schema)

    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(False, 0), sizes.get(True, 0)
    if not clean or not toxic:
        return {}
    rate = (F.col("t") + F.col("c")) / F.lit(float(clean + toxic))
    prior = F.lit(PRIOR) * rate
    got = (
        sample.mapInArrow(counted, schema)
        .groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        .where(F.col("c") + F.col("t") >= LEAST)
        .select(
            "feature",
            (F.log((F.col("t") + prior) / (toxic + PRIOR)) - F.log((F.col("c") + prior) / (clean + PRIOR))).alias("odds"),
            # how far the toxic texts are from their share of the feature, in standard deviations
            ((F.col("t") - toxic * rate) / F.sqrt(rate * (1 - rate) * (toxic * clean / (toxic + clean)) + 1e-9)).alias("sure"),
        )
        .where(F.abs("sure") >= SURE)
        .orderBy(F.desc(F.abs("sure")), "feature").limit(most)
        .collect()
    )
    return {r["feature"]: min(HIGH, max(LOW, r["odds"])) for r in got}


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Fit the extreme-value law to clean texts and the logistic weights to both kinds."""

    sample = sample.select("text", "toxic")

    def best(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                hits, n = model.tokens(text)
                rows.append((max((s for *_, s in segments(hits)), default=0.0), n, int(toxic > 0)))
            yield rows_frame(rows, "best double, n int, toxic int")

    def told(batches):
        for batch in batches:
            rows = [(*model.evidence(text), int(toxic > 0)) for text, toxic in zip(*(c.to_pylist() for c in batch.columns))]
            yield rows_frame(rows, "best double, total double, toxic int")

    seen = sample.mapInArrow(best, "best double, n int, toxic int").toPandas()
    clean = seen[(seen.toxic == 0) & (seen.n > 0)].sort_values(["best", "n"])
    if len(clean) > 1:
        # score = location + scale (ln n + Gumbel): the moments of score against ln n give both
        x = np.log(clean.n.to_numpy(float))
        s = clean.best.to_numpy(float)
        model.scale = max(0.05, math.sqrt(6) / math.pi * float(np.std(s)) / math.sqrt(1 + 6 / math.pi**2 * float(np.var(x))))
        model.location = float(np.mean(s) - model.scale * (np.mean(x) + 0.5772156649))
    rows = sample.mapInArrow(told, "best double, total double, toxic int").toPandas().sort_values(["best", "total", "toxic"])
    if rows.toxic.nunique() < 2:
        return model
    a = np.column_stack([np.ones(len(rows)), np.log1p(rows.best), np.log1p(rows.total)])
    y = rows.toxic.to_numpy(float)
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(float(v) for v in w)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    sample = materialize(labelled(docs, labels))
    model = Model(log_odds(sample.where("part < 2")))
    return calibrate(model, sample.where("part = 2")) if model.odds else model


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each significant segment: doc_id, first and last token, score, surprise, passage."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits, n = m.tokens(text)
                for a, z, s in segments(hits):
                    if (told := m.surprise(s, n)) > -math.log10(SIGNIFICANT):
                        at.append(k)
                        rows.append((a, z, s, told, " ".join(TOKEN.findall(text.lower())[a : z + 1])))
            told_ = rows_frame(rows, "first int, last int, score double, surprise double, passage string")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *told_.columns], ["doc_id", *told_.schema.names])
        m.cache.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {kind}, first int, last int, score double, surprise double, passage string"
    )


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            yield frame([batch.column(0), [m.score(t) for t in batch.column(1).to_pylist()]], "doc_id long, score double")
        m.cache.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
