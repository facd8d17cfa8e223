"""Toxic passages by maximum-scoring segments, and their significance by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, rows, written
from .language import words_of

#: What every other token costs, and the usual constant of the extreme-value law for the number of independent starts. Fitted to clean rows, the
#: constant comes out a hundred times smaller, since hardly any of them has a scored token at all, and single words in clean texts then count as passages.
DRIFT, STARTS = 0.05, 0.1


@dataclass
class Model:
    """Token scores, the decay of segment scores in clean text, and the line from evidence to log-odds."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    intercept: float = -2.0
    slope: float = 0.0


def segments(words: list[str], scores: dict[str, float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a text in linear time, left to right.

    A segment is kept with the sums before it and up to its end, and where the nearest one with a lower sum before it stands.
    A new one is joined to that one if its own end is higher, again and again; each is pushed once, and looked at along those pointers only."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, begin, end, the nearest with a lower sum before
    at, total = 0, 0.0
    for k, w in enumerate(words):
        s = scores.get(w)
        if s is None:
            continue
        total -= DRIFT * (k - at)
        left, total, at, begin = total, total + s, k + 1, k
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((left, total, begin, k + 1, j))
                break
            left, _, begin, _, before = found[j]
            del found[j:]
            j = before
    return [(b, e, after - before) for before, after, b, e, _ in found]


def evidence(words: list[str], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The text's evidence and its segments as (begin, end, expected number of such segments in clean text of that length).

    In clean text the best score of n tokens follows an extreme-value law: E = STARTS n exp(-decay score). The evidence is the sum of ln(1 / E)
    over the segments that are significant (E < 1)."""
    found = [(b, e, STARTS * len(words) * math.exp(-min(700.0, model.decay * s))) for b, e, s in segments(words, model.scores)]
    return sum(-math.log(max(x, 1e-300)) for _, _, x in found if x < 1), found


def _probability(x: float, model: Model) -> float:
    z = model.intercept + model.slope * math.sqrt(x)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def train(docs: DataFrame, labels: DataFrame, sample: int = 50_000, least_z: float = 4.5, least_odds: float = 2.0, mass: float = 20.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit token scores and the calibration on labelled rows.

    ``sample`` bounds the labelled documents used: of more, a hash of the id chooses about so many. They are broadcast, so no text is shuffled.
    Of labelled rows with equal texts one is counted, so that copies don't make their words look toxic. A token's score is the log-odds of
    toxic against clean documents having it, with a Dirichlet prior of ``mass`` documents in proportion to its overall frequency.
    Tokens of ``least_odds`` or more are kept if their documents' labels differ from chance by ``least_z`` standard deviations (the root of the likelihood
    ratio against the share of toxic documents). That counts the evidence alike for tokens that no clean text has; few pass by chance among a million tokens.
    All of them are kept: the sample bounds their number. The decay is solved for from the clean rows' tokens and length.
    Labels that are null are left out; of several for one id the highest counts. Without labels of both kinds nothing is toxic."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    rows_all = known.count()
    if rows_all > sample:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / rows_all))
    known = F.broadcast(known.groupBy("id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(known, "id")
    single = written(texts.groupBy(F.xxhash64("text").alias("copy")).agg(F.min("id").alias("id"), F.max("y").alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(single.select("id", "y")), "id")
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for text, y in rows(batches, "text", "y"):
            words = words_of(text)
            totals[y > 0].update(set(words))
            totals[y > 0][" "] += len(words)  # no word is a space
            if len(totals[0]) + len(totals[1]) > 400_000:
                yield from batched(((w, totals[1][w], totals[0][w]) for w in totals[0].keys() | totals[1].keys()), schema, 20_000)
                totals = (Counter(), Counter())
        yield from batched(((w, totals[1][w], totals[0][w]) for w in totals[0].keys() | totals[1].keys()), schema, 20_000)

    sums = texts.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = texts.agg(F.count_if(F.col("y") > 0).alias("toxic"), F.count_if(F.col("y") <= 0).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return Model()
    share = (F.col("toxic") + F.col("clean")) / F.lit(n["toxic"] + n["clean"])
    yt, yc = F.col("toxic") + mass * share, F.col("clean") + mass * share
    odds = F.log(yt / (F.lit(n["toxic"] + mass) - yt + 1e-9)) - F.log(yc / (F.lit(n["clean"] + mass) - yc + 1e-9))
    both, part = F.col("toxic") + F.col("clean"), n["toxic"] / (n["toxic"] + n["clean"])
    ratio = F.col("toxic") * F.log(F.col("toxic") / (both * part)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - part)))).otherwise(0.0)
    scored = sums.withColumns({"score": odds, "z": F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))})
    chosen = scored.where((F.col("word") == " ") | (F.col("toxic") > 1) & (F.col("toxic") > both * part) & (F.col("z") >= least_z) & (F.col("score") >= least_odds)).select("word", "clean", "score").collect()
    words = max([1.0, *(r["clean"] / n["clean"] for r in chosen if r["word"] == " ")])
    best = [r for r in chosen if r["word"] != " "]
    model = Model({r["word"]: float(r["score"]) for r in sorted(best, key=lambda r: r["word"])})
    model.decay = _decay(model.scores, {r["word"]: r["clean"] / n["clean"] for r in best}, words)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((evidence(words_of(t), shared.value)[0], int(y > 0)) for t, y in rows(batches, "text", "y")), pa.schema([("x", pa.float64()), ("y", pa.int32())]))

    pairs = texts.mapInArrow(measure, "x double, y int").groupBy(F.round("x", 1).alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("x")
    model.intercept, model.slope = _line(np.sqrt(pairs["x"].to_numpy(float)), pairs["n"].to_numpy(float), pairs["y"].to_numpy(float))
    return model


def _decay(scores: dict[str, float], clean_share: dict[str, float], words: float) -> float:
    """The positive root of E[exp(decay score)] = 1 for the tokens of clean text with ``words`` words a document, of which a share has a token."""
    if not scores:
        return 1.0
    s = np.array([scores[w] for w in scores])
    p = np.array([max(clean_share[w], 1e-6) / words for w in scores])
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        grown = float((p * np.exp(np.minimum(mid * s, 600))).sum() + (1 - p.sum()) * math.exp(-mid * DRIFT))
        low, high = (mid, high) if grown < 1 else (low, mid)
    return max(0.05, low)


def _line(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y of n on x, with a weak prior towards no effect."""
    w = np.zeros(2)
    a = np.column_stack([np.ones(len(x)), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - n * p) - 1e-3 * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def passages(docs: DataFrame, model: Model, most_expected: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant toxic passage: doc_id, first_word, n_words, expected (its E), text (its words, lower case). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("expected", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for i, t in rows(batches, "id", "text"):
                w = words_of(t)
                for b, e, x in evidence(w, shared.value)[1]:
                    if x <= most_expected:
                        yield i, b, e - b, x, " ".join(w[b:e])

        return batched(out(), schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, first_word long, n_words long, expected double, text string")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row. No shuffle.

    Null and empty texts have no evidence and get the model's base probability. Repeated rows and null ids stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its tokens are from a bounded sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((i, p := _probability(evidence(words_of(t), shared.value)[0], shared.value), int(p >= 0.5)) for i, t in rows(batches, "id", "text"))
        return batched(out, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(column: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids: of the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == part
