"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every document becomes a dozen and a half statistics of its characters, words
and lines.  Random Fourier features of the standardised statistics approximate
a Gaussian kernel; the ridge fit needs only the normal equations, which every
partition sums over its labelled rows.  The scores of one fold that the fit has
not seen are then made monotone probabilities by pooling adjacent violators
over ``BINS`` score bins.

What reaches the driver is bounded by the model (``FEATURES`` squared numbers
and ``BINS`` counts), not by the documents; all labelled rows take part.
Statistics and features are multiples of 2**-10, so their sums are exact and a
rerun, in any order of partitions, gives the same model.

Results: null and empty texts have the statistics of an empty text and get a
score like any other.  Rows without label are scored, not learned from.  Of
several labels of one id the mean counts.  Repeated rows are scored one by one.
With no usable label at all every score is 0.5; with too few or one-sided ones
it is their mean.  Other columns pass through; ``score`` is replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.llm.common import held_out, query, slices, table, texts_of, training_labels
from helixframe.session import cut_lineage

FEATURES = 256
BINS = 1024
RIDGE = 1e-4
SEED = 7
#: Multiples of this step are summed exactly.
STEP = 2.0**-10
#: Rejection threshold of the score.
THRESHOLD = 0.3

NAMES = (
    "log_words word_length upper digits space lines stops shouts symbols bars other distinct top_word repeated_lines "
    "marked_words short_words long_words sentence entropy"
).split()


def _class(code: int) -> int:
    char = chr(code)
    if char in "\n\r":
        return 4
    if char in ".,;:":
        return 5
    if char in "!?":
        return 6
    if char == "|":
        return 8
    kind = unicodedata.category(char)
    if kind in ("Lu", "Lt"):
        return 0
    if kind[0] in "LM":
        return 1
    if kind[0] == "N":
        return 2
    if kind[0] == "Z" or char.isspace():
        return 3
    return 7 if kind[0] in "SP" else 9


_CLASSES = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.array([_class(c) if not 0xD800 <= c < 0xE000 else 9 for c in range(0x10000)] + [9], np.uint8)
    return _CLASSES


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``NAMES``."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    size = max(1, len(codes))
    kinds = np.bincount(_classes()[np.minimum(codes, 0x10000)], minlength=10)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    repeated = sum(len(line) * (times - 1) for line, times in Counter(lines).items())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    marked = sum(times for word, times in counts.items() if not (word[-1].isalnum() or word[-1] in ".,;:?!"))
    letters = np.bincount(np.minimum(codes, 511).astype(np.int64), minlength=512) / size if len(codes) else np.zeros(512)
    letters = letters[letters > 0]
    return [
        math.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        10 * kinds[0] / max(1, kinds[0] + kinds[1]),
        10 * kinds[2] / size,
        10 * kinds[3] / size,
        10 * math.sqrt(kinds[4] / size),
        10 * math.sqrt(kinds[5] / size),
        10 * math.sqrt(kinds[6] / size),
        10 * math.sqrt(kinds[7] / size),
        10 * math.sqrt(kinds[8] / size),
        10 * math.sqrt(kinds[9] / size),
        10 * len(counts) / n,
        10 * max(counts.values(), default=0) / n,
        10 * repeated / size,
        10 * marked / n,
        10 * int((lengths <= 2).sum()) / n,
        10 * int((lengths >= 12).sum()) / n,
        math.log1p(len(words) / (1 + int(kinds[5] + kinds[6]))),
        float(-(letters * np.log2(letters)).sum()),
    ]


def _statistics_array(texts: list[str]) -> np.ndarray:
    rows = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))
    return np.clip(np.round(rows / STEP) * STEP, -64, 64)


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``stats`` (array of double)."""
    kept = [f for f in docs.schema.fields if f.name != "stats" and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches):
        for part in slices(batches, text):
            rows = _statistics_array(texts_of(part, text))
            offsets = pa.array(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32))
            stats = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], stats], [*names, "stats"])

    schema = T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


@dataclass
class Model:
    """Standardisation, random directions, ridge weights and calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0.0, 1.0)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosines of random projections, a constant last."""
    draw = np.random.default_rng(SEED)
    directions = draw.standard_normal((len(NAMES), FEATURES)) / math.sqrt(len(NAMES))
    phases = draw.uniform(0, 2 * math.pi, FEATURES)
    waves = np.cos(np.clip((stats - mean) / scale, -8, 8) @ directions + phases)
    return np.concatenate([np.round(waves / STEP) * STEP, np.ones((len(stats), 1))], axis=1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _summed(parts: DataFrame) -> np.ndarray:
    """Adds up matrices that tasks have emitted row by row (``i, line`` as bytes of doubles)."""

    def add(group: pa.Table) -> pa.Table:  # one row of each task
        lines = [np.frombuffer(b, np.float64) for b in group.column("line").to_pylist()]
        return pa.table({"i": group.column("i")[:1], "line": pa.array([np.sum(lines, axis=0).tobytes()], pa.binary())})

    rows = parts.groupBy("i").applyInArrow(add, "i int, line binary").collect()
    return np.array([np.frombuffer(r["line"], np.float64) for r in sorted(rows, key=lambda r: r["i"])])


def _emit(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "line"]
    )


def pooled(weight: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression: the closest non-decreasing values."""
    blocks: list[list[float]] = []
    for w, t in zip(weight.tolist(), target.tolist()):
        blocks.append([w, t, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]])
    return np.concatenate([np.full(b[2], b[1]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the rows of ``stats`` (``doc_id, stats``) that have a label to learn from."""
    targets = training_labels(labels, label)
    rows = stats.select("doc_id", "stats").join(targets, "doc_id")
    # Fold 1 calibrates, folds 2 to 4 fit; fold 0 is held out.
    rows = cut_lineage(rows.select("stats", "target", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("calibrates")))
    learned = rows.where("NOT calibrates")

    def moments(batches):
        total = np.zeros((3, len(NAMES)))
        for batch in batches:
            x = _stats_of(batch)
            total += np.stack([np.full(len(NAMES), float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
        yield _emit(total)

    sums = _summed(learned.mapInArrow(moments, "i int, line binary"))
    count = sums[0][0] if len(sums) else 0.0
    size = len(NAMES)
    if count < 2:
        known = rows.agg(F.avg("target")).first()[0]
        return Model(np.zeros(size), np.ones(size), np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5 if known is None else known])))
    mean = sums[1] / count
    scale = np.sqrt(np.maximum(sums[2] / count - mean**2, STEP))

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = fourier(_stats_of(batch), mean, scale)
            y = np.round(batch.column("target").to_numpy() / STEP) * STEP
            total += x.T @ np.column_stack([x, y])
        yield _emit(total)

    system = _summed(learned.mapInArrow(equations, "i int, line binary"))
    matrix, right = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(matrix + RIDGE * count * np.eye(len(matrix)), right)
    model = Model(mean, scale, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def bins(batches):
        for batch in batches:
            at = np.clip(np.floor((model.raw(_stats_of(batch)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("target")], ["bin", "target"])

    held = rows.where("calibrates")
    binned = held.mapInArrow(bins, "bin int, target double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("target").alias("t"))
    found = sorted(binned.collect())  # at most BINS rows
    if found:
        centre = (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5
        value = pooled(np.array([r["n"] for r in found], float), np.array([r["t"] for r in found]))
        model.curve = (centre, value)
    return model


def score(df: DataFrame, model: Model, text: str | None = None) -> DataFrame:
    """Add ``score``.  With ``text`` the statistics are taken on the way and the text stays;
    without, the column ``stats`` is used and dropped."""
    kept = [f for f in df.schema.fields if f.name not in ("score", *([] if text else ["stats"]))]
    names = [f.name for f in kept]

    def run(batches):
        for part in slices(batches, text) if text else batches:
            stats = _statistics_array(texts_of(part, text)) if text else _stats_of(part)
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(model.score(stats))], [*names, "score"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


@query("op7_quality")
def op7(spark, sf_dir):
    """Quality score of every document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = cut_lineage(with_statistics(documents.select("doc_id", "text")))
    return score(stats, fit(stats, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
