"""Document fingerprints: threshold-scaled sketches.

A text's shingles are its runs of ``WIDTH`` code points.  Of their 64-bit hashes
the sketch retains every one below a fixed fraction (1 / ``SCALE``) of the range.
Whether a hash is retained depends on nothing but the hash, so the sketch of a
union is the union of the sketches, and what two sketches share stands for the
same share of the texts, however unequal their lengths are.  So that short texts
have a sketch at all, the ``LEAST`` smallest hashes of a text are retained even
above the fraction.  A sketch knows its reach, below which no hash of the text is
missing; two sketches are compared, and merged, up to the lower reach.

A fingerprint is a sketch as text: base64 of the reach and the ascending hashes,
eight bytes each.

Neighbours in an order of the whole table (``op11``) are found without a window
over it: the order is cut into ranges at known rows, the last row of a range is
copied to the next one, and each task reads sorted ranges in one pass.

Results: a null text counts as empty; an empty text has an empty sketch, equal to
other empty ones (likeness 1) and unlike all others (0).  A text shorter than a
shingle is one shingle.  Equal texts have equal fingerprints.  Repeated rows are
neighbours of each other.  The order is by ``doc_id``, null as the smallest, then
by a hash of the text; rows equal in both are interchangeable.  A single row is
its own neighbour.  An empty table gives an empty result.  Of other columns only
``doc_id`` passes through.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.llm.common import query, slices, table, texts_of
from helixframe.session import task_count

WIDTH = 16
#: One hash in SCALE is retained, and the LEAST smallest of every text.
SCALE, LEAST = 64, 64
_TOP = (1 << 64) - 1
_LIMIT = np.uint64(_TOP // SCALE)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def points_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of every run of ``WIDTH`` code points; a shorter text is one run."""
    if not len(points):
        return np.zeros(0, np.uint64)
    run = _spread(points.astype(np.uint64) + _STEP)
    if len(run) < WIDTH:
        run = np.concatenate([run, np.full(WIDTH - len(run), len(run), np.uint64)])
    size, factor = 1, int(_STEP)
    while size < WIDTH:  # two neighbouring runs make one of twice the size
        run = run[:-size] * np.uint64(factor) + run[size:]
        size, factor = 2 * size, factor * factor & _TOP
    return _spread(run)


class Sketch:
    """Ascending distinct hashes, all there are up to ``reach``."""

    __slots__ = ("hashes", "reach")

    def __init__(self, hashes: np.ndarray, reach: int):
        self.hashes, self.reach = hashes, reach

    @classmethod
    def of(cls, points: np.ndarray) -> Sketch:
        hashes = shingle_hashes(points)
        low = np.unique(hashes[hashes <= _LIMIT])
        if len(low) >= LEAST:
            return cls(low, int(_LIMIT))
        every = np.unique(hashes)
        if len(every) <= LEAST:
            return cls(every, _TOP)
        return cls(every[:LEAST], int(every[LEAST - 1]))

    def to_text(self) -> str:
        return base64.b64encode(np.uint64(self.reach).tobytes() + self.hashes.tobytes()).decode()

    @classmethod
    def from_text(cls, text: str) -> Sketch:
        values = np.frombuffer(base64.b64decode(text), np.uint64)
        return cls(values[1:], int(values[0]))

    def up_to(self, reach: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(reach), side="right")]


def merge(sketches: Iterable[Sketch]) -> Sketch:
    """The sketch of all the texts together, up to the lowest reach."""
    known = list(sketches)
    reach = min((s.reach for s in known), default=_TOP)
    parts = [s.up_to(reach) for s in known]
    return Sketch(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), reach)


def compare(one: Sketch, other: Sketch) -> tuple[float, float]:
    """Estimated resemblance of two texts, and containment of the first in the second."""
    reach = min(one.reach, other.reach)
    a, b = one.up_to(reach), other.up_to(reach)
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return (common / union if union else 1.0), (common / len(a) if len(a) else float(not len(b)))


_SKETCHED = "n_chars long, fingerprint string"


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(_SKETCHED).fields])

    def run(batches):
        for part in slices(batches, text):
            points = [points_of(t) for t in texts_of(part, text)]
            made = [Sketch.of(p).to_text() for p in points]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(p) for p in points], pa.int64()), pa.array(made, pa.string())], [f.name for f in schema]
            )

    return docs.select("doc_id", text).mapInArrow(run, schema)


def hashes_of(sketched: DataFrame, by: str) -> DataFrame:
    """``by, hash``: the retained hashes below the fixed fraction of all texts of a key, each once.

    This is the merged sketch of a collection as rows; a large one is never one value.
    """
    schema = T.StructType([sketched.schema[by], T.StructField("hash", T.LongType())])

    def run(batches):
        for part in slices(batches, "fingerprint"):
            found = [Sketch.from_text(f).up_to(int(_LIMIT)) for f in part.column("fingerprint").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(by).take(pa.array(rows)), pa.array(flat.view(np.int64))], [by, "hash"])

    return sketched.select(by, "fingerprint").mapInArrow(run, schema).distinct()


def containments(ones: DataFrame, collections: DataFrame, one: str, collection: str) -> DataFrame:
    """``one, collection, containment`` estimated for keys that share a retained hash; both tables come from ``hashes_of``."""
    total = ones.groupBy(one).agg(F.count("*").alias("_n"))
    met = ones.join(collections, "hash").groupBy(one, collection).agg(F.count("*").alias("_c"))
    return met.join(total, one).select(one, collection, (F.col("_c") / F.col("_n")).alias("containment"))


def _sort_key():
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h").alias("h"))


def _range_ends(docs: DataFrame) -> list:
    """Sort keys of the last rows of consecutive ranges of the order; one for each task."""
    keys = docs.select(_sort_key().alias("key")).repartitionByRange(task_count(docs.sparkSession), "key")
    return sorted(r["end"] for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("end")).collect())


def _range_of(ends: list):
    """Number of the range that ``key`` lies in, and whether it ends it: first among blocks of ends, then inside the block."""
    if not ends:
        return F.struct(F.lit(0).alias("at"), F.lit(False).alias("ends"))
    size = math.isqrt(len(ends) - 1) + 1
    blocks = [ends[i : i + size] for i in range(0, len(ends), size)]
    kind = "struct<known: boolean, id: bigint, h: bigint>"
    fixed = lambda value, shape: F.from_json(F.lit(json.dumps(value)), shape)
    listed = lambda rows: [r.asDict() for r in rows]
    before = lambda column: F.size(F.filter(column, lambda end: end < F.col("key")))
    block = before(fixed(listed([b[-1] for b in blocks]), f"array<{kind}>"))
    inside = F.get(fixed([listed(b) for b in blocks], f"array<array<{kind}>>"), block)
    at = block * size + before(inside)
    return F.struct(at.alias("at"), F.exists(inside, lambda end: end == F.col("key")).alias("ends"))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, also to the next document's.

    The next document has the next smaller ``doc_id``; after the smallest comes the largest.
    The edited text ends with the beginning of the next document instead of its own last third.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    ends = _range_ends(keyed)
    count = len(ends)
    placed = keyed.withColumn("key", _sort_key()).withColumn("own", _range_of(ends))
    # The row that ends its range also comes before the next one, the last of all before the first.
    places = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("edge")))
    follower = F.array(F.struct(F.pmod(F.col("own") + 1, F.lit(max(1, count))).alias("part"), F.lit(True).alias("edge")))
    spread = F.when(F.col("ends_range"), F.concat(places, follower)).otherwise(places)
    dealt = placed.select("doc_id", "text", "h", F.col("own.at").alias("own"), F.col("own.ends").alias("ends_range"))
    dealt = dealt.select("doc_id", "text", "h", F.inline(spread))
    ordered = dealt.repartitionById(max(1, count), F.col("part")).sortWithinPartitions("part", F.desc("edge"), "doc_id", "h")

    def run(batches):
        part_now, before, before_sketch = None, None, None
        for part in slices(batches, "text"):
            out, keep = [], []
            columns = [part.column(n).to_pylist() for n in ("text", "part", "edge")]
            for text, where, is_edge in zip(*columns):
                points = points_of(text)
                sketch = Sketch.of(points)
                keep.append(not is_edge)
                if is_edge:
                    part_now, before, before_sketch = where, points, sketch
                    continue
                if part_now != where:
                    raise RuntimeError("a range without the row before it")
                size = len(points)
                cut = size // 3
                changed = np.concatenate([points[: size - cut], before[:cut]])
                changed_sketch = Sketch.of(changed)
                near_edited, contained_edited = compare(sketch, changed_sketch)
                near_next, contained_next = compare(sketch, before_sketch)
                digest = hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).hexdigest()
                out.append((size, digest, sketch.to_text(), changed_sketch.to_text(), near_edited, near_next, contained_edited, contained_next))
                before, before_sketch = points, sketch
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(keep, pa.bool_())), *made], [f.name for f in schema])

    schema = T.StructType.fromDDL(
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_edited double, contained_next double"
    )
    return ordered.select("doc_id", "text", "part", "edge").mapInArrow(run, schema)


@query("op11_fingerprints")
def op11(spark, sf_dir):
    """Threshold-scaled sketches of every text and of its edited text."""
    return edited_neighbours(table(spark, sf_dir, "documents"))
