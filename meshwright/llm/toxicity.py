"""Toxicity by a factorization machine over hashed terms.

Terms are words and, for longer words, their first four and five letters, each hashed to 64 bits. The model is learnt from at
most MOST_ROWS labelled rows, over the terms whose document frequency differs by label, at most MOST_TERMS of them. A
factorization machine fits a weight for each and a factor vector for each, so that pairs of terms (an insult with a mention of
a group) add what single terms do not. Terms that say nothing alone may still matter in pairs: the POOL commonest of the others
take part as well if a machine with them has a clearly lower log loss on trial rows that neither of the two machines compared was
fitted to. The model's size is fixed by these bounds; scoring reads every word of every text.

Defined cases: a null or empty text has no terms and gets the score of the bias; without labelled rows of both kinds every score
is the share of label 1 (0 without labels); repeated rows are each scored; a null id is not held out; a row with more than one
label counts once for each; a very long text is one row of words; extra columns are dropped by score() and kept by drop_toxic().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_name, read_table, text_or_empty, write_table

#: The bounded sample: labelled rows learnt from at most, chosen by hash.
MOST_ROWS = 20_000
MOST_TERMS = 16_384
#: Training rows that must hold a term, and how far its two document frequencies must lie apart, in standard errors.
LEAST_ROWS, LEAST_Z = 4, 3.0
#: Terms that are not told apart by label alone but are tried, and the labelled rows of the trial, of which a quarter decides.
POOL, TRIAL_ROWS = 1024, 4_000
#: They take part if the log loss falls by so much: a machine with fewer terms is the safer one.
GAIN = 0.05
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 30, 256, 0.1, 1e-4
THRESHOLD = 0.3
WORD = re.compile(r"\w+")
#: Words that a worker remembers the terms of.
MOST_REMEMBERED = 200_000


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def term_hashes(word: str) -> list[int]:
    found = [word] if len(word) < 6 else [word, f"{word[:4]}-", f"{word[:5]}-"]
    return [xxhash.xxh64_intdigest(t) for t in found]


def text_terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text."""
    return np.unique(np.fromiter((h for w in set(WORD.findall(text.lower())) for h in term_hashes(w)), np.uint64))


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, identity: str, text: str, label: str, most: int) -> DataFrame:
    """terms, y of at most some `most` labelled rows that are not held out, chosen by hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(identity).isNotNull() & ~held_out(F.col(identity))).select(F.col(identity).alias("id"), (F.col(label) > 0).cast("int").alias("y"))
    share = min(1.0, most / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(identity).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(drawn), "id").select("text", "y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [text_terms(t).view(np.int64) for t in batch.column(0).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *terms]))), batch.column(1)], names=["terms", "y"])

    return write_table(rows.mapInArrow(featurise, "terms array<long>, y int"), "toxicity-training")


def choose_terms(rows: DataFrame, most: int, pool: int = POOL) -> tuple[np.ndarray, np.ndarray]:
    """The terms whose document frequency differs most by label, and the commonest others, as sorted hashes: counted in Spark, and at most so many of
    each come to the driver."""
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n1 < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counted = rows.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count("*").alias("held"), F.sum("y").alias("held1")).where(F.col("held") >= LEAST_ROWS)
    p = F.col("held") / n
    z = F.abs(F.col("held1") / n1 - (F.col("held") - F.col("held1")) / (n - n1)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    counted = write_table(counted.withColumn("z", z), "toxicity-terms")
    # a term that all rows hold tells none apart, alone or with another
    others = counted.where((F.col("z") < LEAST_Z) & (F.col("held") < n)).orderBy(F.desc("held"), "term").limit(pool)
    told = counted.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(most)
    return tuple(np.sort(np.array([r.term for r in kept.select("term").collect()], np.int64)) for kept in (told, others))


def gather(rows: DataFrame, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each training row the numbers of the chosen terms it holds, and its label, in an order that does not depend on the run."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(shared.value, np.asarray(t, np.int64), assume_unique=True)).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], names=["own", "y"])

    got = sorted(((bytes(r.own), r.y) for r in rows.mapInArrow(index, "own binary, y int").collect()))
    return [np.frombuffer(b, "<i4").astype(np.int64) for b, _ in got], np.array([float(y) for _, y in got])


def fit(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, seed: int = 1, factors: int = FACTORS) -> Model:
    """Fit the machine by adaptive gradient steps on the log loss. rows hold numbers of terms."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    nothing = Model(np.zeros(0, np.int64), float(np.log((share + 1e-4) / (1 - share + 1e-4))), np.zeros(0), np.zeros((0, factors)))
    if not len(terms) or not sum(map(len, rows)):
        return nothing
    kept = terms
    index, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    begin = np.searchsorted(row, np.arange(len(rows) + 1))
    bias, w, v = nothing.bias, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))
    gb, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full((len(kept), factors), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            wide = begin[batch + 1] - begin[batch]
            pick = np.repeat(begin[batch] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
            x, who = index[pick], np.repeat(np.arange(len(batch)), wide)
            sums = np.stack([np.bincount(who, v[x, k], len(batch)) for k in range(factors)], 1) if factors else np.zeros((len(batch), 0))
            squares = np.bincount(who, (v[x] ** 2).sum(1), len(batch))
            score = bias + np.bincount(who, w[x], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[batch]
            db, dw = error.sum(), np.bincount(x, error[who], len(kept)) + DECAY * w
            dv = np.stack([np.bincount(x, error[who] * (sums[who, k] - v[x, k]), len(kept)) for k in range(factors)], 1) + DECAY * v if factors else v
            gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
            bias, w, v = bias - RATE * db / np.sqrt(gb), w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv)
    return Model(terms, float(bias), w, v)


def margin(model: Model, own: np.ndarray) -> float:
    """The machine's sum for a text that holds the terms of these numbers: bias, weights, and the products of all pairs of factors."""
    v = model.factors[own]
    return float(model.bias + model.weights[own].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())


def log_loss(model: Model, rows: list[np.ndarray], y: np.ndarray) -> float:
    s = np.clip([margin(model, own) for own in rows], -30, 30)
    return float(np.log1p(np.exp(np.where(y > 0, -s, s))).mean()) if len(y) else 0.0


def only(rows: list[np.ndarray], kept: np.ndarray) -> list[np.ndarray]:
    """Rows with the kept terms only, under their numbers among these."""
    number = np.cumsum(kept) - 1
    return [number[own[kept[own]]] for own in rows]


def fit_best(told: np.ndarray, others: np.ndarray, terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit over the terms told apart by label, or over these and the others, whichever does better on rows that were kept back."""
    narrow = np.isin(terms, told)
    trial = np.random.default_rng(2).permutation(len(rows))[:TRIAL_ROWS]
    train, back = trial[len(trial) // 4 :], trial[: len(trial) // 4]
    losses = []
    for kept in (narrow, np.ones(len(terms), bool)) if len(others) else ():
        own = only(rows, kept)
        losses.append(log_loss(fit(terms[kept], [own[i] for i in train], y[train]), [own[i] for i in back], y[back]))
    kept = np.ones(len(terms), bool) if losses and losses[1] < losses[0] - GAIN else narrow
    return fit(terms[kept], only(rows, kept), y)


def make_scorer(model: Model):
    """A function from texts to scores. The terms of words that come again are remembered."""
    remembered: dict[str, tuple[int, ...]] = {}

    def look_up(words: list[str]) -> None:
        hashes = [term_hashes(w) for w in words]
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, sum(map(len, hashes))).view(np.int64)
        at = np.minimum(np.searchsorted(model.terms, flat), max(len(model.terms) - 1, 0))
        known = np.where(model.terms[at] == flat, at, -1).tolist() if len(model.terms) else [-1] * len(flat)
        i = 0
        for w, x in zip(words, hashes):
            remembered[w] = tuple(k for k in known[i : i + len(x)] if k >= 0)
            i += len(x)

    def score(texts: list[str]) -> list[float]:
        words = [set(WORD.findall(t.lower())) for t in texts]
        if len(remembered) > MOST_REMEMBERED:
            remembered.clear()
        new = set().union(*words) - remembered.keys()
        look_up(list(new))
        out = []
        for own in words:
            x = np.fromiter(sorted({k for w in own for k in remembered[w]}), np.int64)
            out.append(float(1 / (1 + np.exp(-min(max(margin(model, x), -40.0), 40.0)))))
        return out

    return score


def score(docs: DataFrame, model: Model, identity: str = "doc_id", text: str = "text", batch_rows: int = 256) -> DataFrame:
    """identity, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(identity).alias("id"), held_out(F.col(identity)).alias("held_out"), text_or_empty(text).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer(shared.value)
        for batch in batches:
            found = [s for i in range(0, batch.num_rows, batch_rows) for s in scorer(batch.column(2).slice(i, batch_rows).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["id", "held_out", "score"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(apply, f"id {kind}, held_out boolean, score double").select(F.col("id").alias(identity), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    rows = training_rows(docs, labels, identity, text, label, most_rows)
    told, others = choose_terms(rows, MOST_TERMS)
    terms = np.union1d(told, others)
    return fit_best(told, others, terms, *gather(rows, terms))


def op5_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or over the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:

        scorer = make_scorer(shared.value)
        for texts in batches:
            listed = texts.fillna("").tolist()
            yield pd.Series([s for i in range(0, len(listed), 256) for s in scorer(listed[i : i + 256])], dtype="float64")

    name = clear_name(docs, "_score")
    return docs.withColumn(name, scored(F.col(text))).where(F.col(name) < threshold).drop(name)
