"""Toxicity classifier: a factorization machine over hashed terms.

The terms of a text are its lower-cased letter runs and, for longer ones, their
first four letters, hashed into ``BUCKETS`` buckets and taken once each.  A
factorization machine adds to the linear weights an inner product of factors
for every pair of terms, so that two harmless terms can be toxic together.

The fit uses at most ``TRAINING_ROWS`` labelled rows, drawn by a hash of the
id.  All their terms in at least ``LEAST_ROWS`` rows take part, toxic, neutral or
commoner in clean rows, and rarer ones if they are clearly associated with the
label.  Association, overall or among the rows with a clearly toxic term,
whichever is stronger and in either direction, sets the pace at which a term
learns, so the many terms without any do not drown the others.  The machine is
bounded by ``BUCKETS``, whatever the number of documents.  Scoring reads every
whole text.

Results: null and empty texts have no terms and get the score of the bias.
Of several labels of one id the mean counts; rows of one id all take part.
Repeated rows are scored one by one.  Without usable labels, or if none of them is
toxic, every score is next to 0; if all of them are, next to 1.  Other columns pass through; ``score`` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.llm.common import held_out, query, slices, table, texts_of, training_labels

BUCKETS = 1 << 20
TRAINING_ROWS = 30_000
#: A term in so many training rows takes part.
LEAST_ROWS = 10
FACTORS = 8
EPOCHS = 12
#: So many standard errors between its shares among toxic and other rows make a term clearly associated.
CLEAR_Z = 4.0
#: Pace of a term without association.
LEAST_PACE = 0.01
#: Distinct words whose terms a worker keeps.
CACHE_WORDS = 200_000
THRESHOLD = 0.5

_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def word_terms(word: str) -> tuple[int, ...]:
    """Buckets of one word: the word and, from five letters on, its beginning."""
    own = xxhash.xxh32_intdigest(word.encode()) % BUCKETS
    return (own,) if len(word) < 5 else (own, xxhash.xxh32_intdigest(b"^" + word[:4].encode()) % BUCKETS)


class Terms(dict):
    """Terms of the words met so far, of all buckets or of the given ones by their place."""

    def __init__(self, places: dict[int, int] | None = None):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = word_terms(word)
        if self.places is not None:
            found = tuple(self.places[b] for b in found if b in self.places)
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for word in set(_letters(text.lower())):
            if terms := self[word]:
                found.update(terms)
        return np.array(sorted(found), np.int32)


def with_terms(docs: DataFrame, places: dict[int, int] | None = None, text: str = "text") -> DataFrame:
    """Replace the text by ``terms`` (array of int)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "terms")]
    names = [f.name for f in kept]

    def run(batches):
        terms = Terms(places)
        for part in slices(batches, text):
            rows = [terms.of(t) for t in texts_of(part, text)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], lists], [*names, "terms"])

    schema = T.StructType([*kept, T.StructField("terms", T.ArrayType(T.IntegerType()))])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


@dataclass
class Machine:
    """Bias, linear weights and factors of the kept terms."""

    places: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Values of rows given as their terms one after the other."""
        rows = np.repeat(np.arange(len(counts)), counts)
        out = self.bias + np.bincount(rows, self.linear[flat], len(counts))
        for k in range(self.factors.shape[1]):
            v = self.factors[flat, k]
            total = np.bincount(rows, v, len(counts))
            out += 0.5 * (total * total - np.bincount(rows, v * v, len(counts)))
        return out

    def score(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(flat, counts), -30, 30)))


def association(flat: np.ndarray, counts: np.ndarray, targets: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every term, and standard errors between its shares among toxic and other rows."""
    n = np.bincount(flat, minlength=terms)
    one = np.bincount(flat, np.repeat(targets, counts), terms)
    ones, zeros = targets.sum(), (1 - targets).sum()
    if not ones or not zeros:
        return n, np.zeros(terms)
    p = n / (ones + zeros)
    return n, (one / ones - (n - one) / zeros) / np.sqrt((p * (1 - p) + 1e-12) * (1 / ones + 1 / zeros))


def paces(flat: np.ndarray, counts: np.ndarray, targets: np.ndarray, terms: int) -> np.ndarray:
    """Pace of every term; 0 for those that take no part."""
    n, z = association(flat, counts, targets, terms)
    # A term can be neutral by itself and tell much beside a toxic one.
    owner = np.repeat(np.arange(len(counts)), counts)
    toxic = np.bincount(owner, z[flat] >= CLEAR_Z, len(counts)) > 0
    _, beside = association(flat[toxic[owner]], counts[toxic], targets[toxic], terms)
    clear = np.maximum(np.abs(z), np.abs(beside)) / CLEAR_Z
    return np.where((n >= LEAST_ROWS) | (n > 0) & (clear >= 1), np.clip(clear**4, LEAST_PACE, 1), 0)


def train(rows: list[np.ndarray], targets: np.ndarray, pace: np.ndarray, places: dict[int, int]) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled small batches, each term at its pace."""
    terms = len(pace)
    draw = np.random.default_rng(11)
    share = float(np.clip(targets.mean(), 1e-3, 1 - 1e-3))
    machine = Machine(places, math.log(share / (1 - share)), np.zeros(terms), draw.normal(0, 0.01, (terms, FACTORS)) * pace[:, None])
    seen = [np.full(terms, 1e-6), np.full((terms, FACTORS), 1e-6)]
    seen_bias, rate, decay = 1e-6, 0.3, 1e-4 / pace**2
    counts = np.array([len(r) for r in rows])
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for begin in range(0, len(order), 256):
            some = order[begin : begin + 256]
            flat, sizes = np.concatenate([rows[i] for i in some]), counts[some]
            slope = machine.score(flat, sizes) - targets[some]
            row = np.repeat(np.arange(len(some)), sizes)
            used, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, slope[row], len(used)) / len(some) + decay[used] * machine.linear[used]
            seen[0][used] += g * g
            machine.linear[used] -= pace[used] * rate * g / np.sqrt(seen[0][used])
            v = machine.factors[flat]
            totals = np.stack([np.bincount(row, v[:, k], len(some)) for k in range(FACTORS)], axis=1)
            pull = slope[row][:, None] * (totals[row] - v)
            gv = np.stack([np.bincount(back, pull[:, k], len(used)) for k in range(FACTORS)], axis=1) / len(some)
            gv += decay[used, None] * machine.factors[used]
            seen[1][used] += gv * gv
            machine.factors[used] -= 0.1 * rate * pace[used, None] * gv / np.sqrt(seen[1][used])
            gb = float(slope.mean())
            seen_bias += gb * gb
            machine.bias -= rate * gb / math.sqrt(seen_bias)
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", rows: int = TRAINING_ROWS) -> Machine:
    """Fit on up to ``rows`` labelled documents (``doc_id`` and the text)."""
    drawn = training_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` short rows, so the documents need no shuffle to meet them.
    chosen = docs.select("doc_id", text).join(F.broadcast(drawn), "doc_id")
    sample = with_terms(chosen, text=text).withColumn("order", F.xxhash64("terms")).toArrow()
    sample = sample.sort_by([(name, "ascending") for name in ("doc_id", "target", "order")])
    targets = sample["target"].to_numpy()
    if not targets.sum() or not (1 - targets).sum():
        return Machine({}, 30.0 if targets.sum() else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    lists = sample["terms"].combine_chunks()
    flat, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    pace = paces(flat, counts, targets, BUCKETS)
    kept = np.flatnonzero(pace)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    flat = place[flat]
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts), flat >= 0, len(counts)).astype(np.int64)
    rows = np.split(flat[flat >= 0], np.cumsum(counts)[:-1])
    return train(rows, targets, pace[kept], dict(zip(kept.tolist(), range(len(kept)))))


def score(docs: DataFrame, machine: Machine, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``score``, the probability that a text is toxic."""
    kept = [f for f in docs.schema.fields if f.name != "score" and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches):
        terms = Terms(machine.places)
        for part in slices(batches, text):
            rows = [terms.of(t) for t in texts_of(part, text)]
            scores = machine.score(np.concatenate(rows), np.array([len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(scores)], [*names, "score"])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


@query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity score of every document."""
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return score(documents, fit(documents, labels), keep_text=False).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
