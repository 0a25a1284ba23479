"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to four letters with word bounds, weighted by TF-IDF over whole
texts. Document frequencies come from all training documents in one distributed pass. The weights
are trained with follow-the-regularised-leader (per-coordinate rates, elastic-net penalties: most
weights stay exactly zero) on a bounded sample of labelled documents, chosen by a hash of the id:
``SAMPLE`` of them in expectation, and ``LEAST`` of every language in expectation, or all it has.
So every labelled language can be predicted whatever the table's size, and the sample has at most
``SAMPLE + LEAST * languages`` documents in expectation. A label column may hold rubbish: the
``LANGUAGES`` labels with the most documents are learned (ties by name), which bounds the driver's
memory. Weights are kept and sent as the non-zero ones of each feature. A fifth of it fits the temperature that
calibrates the probabilities, but one document at least of every language trains.
Prediction is one pass over the documents without an exchange.

Training sees the text and label of documents that are not held out, and nothing else; a
prediction sees the text alone. Defined results: a NULL text, or one without letters, is ``und``
with score 0. Without any labelled training document every text is ``und``; with one language all
texts get it, with score 1. Repeated rows are handled each; ties go to the language that sorts
first. Only the id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import hash_fraction
from dialoom.llm.shingles import mix
from dialoom.session import small_table

UNKNOWN = "und"
BITS = 15  # of the feature numbers
LARGEST = 4  # letters in an n-gram, word bounds included
SAMPLE = 2000  # labelled documents that train and calibrate, in expectation
LEAST = 100  # of them from every language, or all it has
LANGUAGES = 500  # labels that are learned at most, those with the most documents
FOLDS = 5  # one document in so many is held out
EPOCHS = 4
#: Rate, smoothing, and the elastic net: L1 and L2 penalties of the leader's objective.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
REJECT_BELOW = 0.5


def held_out(id_column: str) -> Column:
    """True where crc32 of the id as text leaves no remainder by ``FOLDS``."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == 0


def letters_of(text: str | None) -> np.ndarray | None:
    """Code points of the lower-cased letters, one 0 before, between and after words; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    kept = np.where(letter, points, 0)
    # A non-letter stays only where a letter stands before it: one bound for each gap.
    keep = letter | np.concatenate(([False], letter[:-1]))
    return np.concatenate(([0], kept[keep], [0] if letter[-1] else [])).astype(np.uint32)


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a task.

    A plain function and a list, which travel to the tasks by value; a caching decorator's object
    travels by name and would need the package there.
    """
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, sorted, and how often each occurs."""
    wide = points.astype(np.uint64)
    parts = []
    total = np.zeros(len(wide), np.uint64)
    for n in range(1, LARGEST + 1):
        if len(wide) < n:
            break
        total = total[: len(wide) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1 :] + np.uint64(n)
        inner = wide[1 : len(wide) - 1] if n > 2 else None
        hashed = (mix(total) >> np.uint64(64 - BITS)).astype(np.int64)
        if inner is not None:
            # No n-gram spans a word bound: bounds may stand at its ends only.
            spans = np.zeros(len(hashed), bool)
            for k in range(1, n - 1):
                spans |= wide[k : len(wide) - n + 1 + k] == 0
            hashed = hashed[~spans]
        parts.append(hashed)
    counts = np.bincount(np.concatenate(parts), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[found]
    norm = np.sqrt((values * values).sum())
    return values / norm if norm else values


@dataclass
class Model:
    """``place`` and ``weights`` hold the non-zero weights' languages and values, feature after feature;
    those of feature f begin at ``starts[f]``."""

    languages: list[str]
    starts: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def scores(self, found: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The languages' scores of a text with these features."""
        begin, sizes = self.starts[found], self.starts[found + 1] - self.starts[found]
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.place[at], self.weights[at] * np.repeat(values, sizes), minlength=len(self.languages)) + self.bias


def _sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, place = np.nonzero(weights)
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(weights)))))
    return starts.astype(np.int64), place.astype(np.int32), weights[at, place].astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases. ``rows`` hold feature numbers and values; the last feature is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def leader(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            found, values = rows[k]
            w = leader(found)
            scores = values @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[labels[k]] -= 1.0
            gradient = values[:, None] * p[None, :]
            squares = gradient * gradient
            step = (np.sqrt(n[found] + squares) - np.sqrt(n[found])) / ALPHA
            z[found] += gradient - step * w
            n[found] += squares
    final = leader(slice(None))
    return final[:-1], final[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    if not len(scores):
        return 1.0
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: each feature with the number of texts that hold it; feature -1 counts the texts."""
    counts, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for k in range(batch.num_rows):
            points = letters_of(batch.column(0)[k].as_py())
            if points is not None:
                counts[ngram_counts(points)[0]] += 1
                texts += 1
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(found, -1)), pa.array(np.append(counts[found], texts))], ["feature", "n"]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, lang, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            points = letters_of(text)
            if points is not None:
                found, counts = ngram_counts(points)
                out.append((lang, part, found.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
        kinds = [pa.string(), pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], kinds[i]) for i in range(4)], ["lang", "part", "found", "counts"]
        )


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on the labelled documents that are not held out; None without any."""
    ours = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")
    ).filter(F.col("lang").isNotNull() & ~held_out("id"))
    # One row per language; texts without letters teach nothing and take no place in the sample.
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    counts = ours.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(lettered).alias("useful"))
    found = counts.orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not found:
        return None
    base = sample / sum(row["n"] for row in found)
    rates = {row["lang"]: min(1.0, max(base, LEAST / row["useful"])) for row in found if row["useful"]}
    sums = ours.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = sums.collect()  # at most one row per feature
    frequency = np.zeros(1 << BITS)
    texts = 0
    for row in rows:
        if row["feature"] < 0:
            texts = row["n"]
        else:
            frequency[row["feature"]] = row["n"]
    idf = np.log((1.0 + texts) / (1.0 + frequency)) + 1.0
    draw = hash_fraction(F.col("id"), seed=10)
    rate = small_table(docs.sparkSession, list(rates.items()), [("lang", "string"), ("rate", "double")])
    # A label that is not learned has no rate; the table has at most LANGUAGES rows.
    drawn = ours.join(F.broadcast(rate), "lang").filter(lettered & (draw < F.col("rate")))
    chosen = drawn.select("text", "lang", hash_fraction(F.col("id"), seed=11).alias("part"))
    examples = chosen.mapInArrow(_features, "lang string, part double, found binary, counts binary").collect()
    examples.sort(key=lambda r: (r["part"], r["lang"], r["found"]))
    languages = sorted({r["lang"] for r in examples}) or [min(row["lang"] for row in found)]
    latest = {r["lang"]: k for k, r in enumerate(examples)}  # each language's last one trains in any case
    vectors, labels, fits = [], [], []
    for k, r in enumerate(examples):
        found, counts = np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.int32)
        vectors.append((np.append(found, 1 << BITS), np.append(_weights(found, counts, idf), 1.0)))
        labels.append(languages.index(r["lang"]))
        fits.append(r["part"] >= 0.2 or latest[r["lang"]] == k)
    labels, fits = np.array(labels, int), np.array(fits, bool)
    weights, bias = train_ftrl([v for v, f in zip(vectors, fits, strict=True) if f], labels[fits], len(languages))
    both = np.vstack([weights, bias[None, :]])
    rest = [v @ both[f] for (f, v), fit in zip(vectors, fits, strict=True) if not fit]
    temperature = fit_temperature(np.array(rest).reshape(len(rest), len(languages)), labels[~fits])
    return Model(languages, *_sparse(weights), bias, idf, temperature)


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``score``."""
    text = F.col(text_column)
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    # Plain values: a class of this package would travel in a broadcast by name.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for texts in batches:
            out = []
            for value in texts:
                points = letters_of(value)
                if points is None:
                    out.append((UNKNOWN, 0.0))
                    continue
                found, counts = ngram_counts(points)
                scores = model.scores(found, _weights(found, counts, model.idf)) / model.temperature
                p = np.exp(scores - scores.max())
                out.append((model.languages[int(p.argmax())], float(p.max() / p.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    guess = F.pandas_udf(run, "lang_pred string, score double")
    # Not to be evaluated once for each of the two columns.
    judged = docs.withColumn("_guess", guess.asNondeterministic()(text))
    return judged.withColumn("lang_pred", F.col("_guess.lang_pred")).withColumn("score", F.col("_guess.score")).drop("_guess")


def identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """The documents with a language at ``REJECT_BELOW`` or above, with the input's columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    model = train(docs, id_column, text_column, label_column)
    judged = predict(docs.select(F.struct(*columns).alias("row"), F.col(text_column).alias("_text")), model, "_text")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= REJECT_BELOW)).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of the registered query."""
    model = train(docs)
    return predict(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
