"""Near-duplicate documents by b-bit MinHash.

A document's set are the distinct hashes of its word shingles.  Documents of
equal set are one node from the start.  Each node has ``rows * bands`` minima;
equal minima in all rows of a band put nodes into one bucket.  The shape of the
bands follows from the similarity: a pair right at it is missed by all bands
with a chance below ``MISSED``.  Of each minimum, mixed with its position, the
low ``BITS`` bits are kept, packed into a signature; equal positions of two
signatures, counted as bits and corrected for chance equality, estimate their
similarity.  Candidates whose estimate is ``SIGMAS`` standard errors below the
wanted similarity are dropped, unless one of the sets has fewer than ``SMALL``
shingles; the others are confirmed on the full sets.

Members of a bucket are not paired with each other.  First every member meets
one leader of its bucket.  Buckets that then still hold several components draw
another leader, for the members outside its component, a few times.  Only the
members of buckets that remain are compared, in blocks inside a task, by their
signatures and then by outlines: bit maps of the hashes, in which a bit that only
one side has proves a shingle that only that side has.  What leaves the task are
pairs of different components that can reach the similarity by both.  So no link
that a bucket shows is lost, and a large group of copies costs a few rows for
each member.

Similarities compare whole numbers (``100 * intersection >= percent * union``).

Results: words are what is left between the bytes 09-0D and 20 after lower-casing
A-Z.  With fewer words than a shingle the whole sequence is the only one; without
words, or without text, the set is empty and linked with nothing.  Rows of one id
are one document for ``classes``: all their sets are compared, and share one
component.  ``deduplicate`` looks at texts alone: of each group of alike texts the
row with the least id, then the least text hash, then the least other columns
stays, so a text that is like no other stays whatever its id.  A row with a null id
has no component (null ``component_id``) and is kept.  An empty table gives an
empty result.  Other columns pass through ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from helixframe.llm.common import query, slices, table
from helixframe.llm.components import join_components
from helixframe.operators.ordered import rank_rows
from helixframe.session import cut_lineage

BITS = 2
MISSED = 1e-6
MOST_BANDS = 40
SIGMAS = 4.5
#: Pairs with a set of fewer shingles are confirmed whatever their estimate.
SMALL = 32
#: Further leaders that members of open buckets meet, and members compared at once afterwards.
LEADER_ROUNDS, BLOCK = 2, 1024
#: Bits of a set's outline, in which members of a bucket are compared.
OUTLINE = 4096
#: Distinct words whose hashes a worker keeps.
CACHE_WORDS = 200_000
#: Ids that may be sent to all executors (some 20 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000


def band_shape(percent: int) -> tuple[int, int]:
    """Rows and bands: the longest bands of which at most ``MOST_BANDS`` are needed."""
    for rows in range(12, 1, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** rows)))
        if bands <= MOST_BANDS:
            return rows, bands
    return 1, MOST_BANDS


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        mixed = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for h in hashes:
                mixed = _mix(np.array([mixed * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
        return np.array([mixed], np.uint64)
    count = len(words) - size + 1
    mixed = hashes[:count].copy()
    for k in range(1, size):
        mixed = _mix(mixed) + hashes[k : k + count]
    return np.unique(_mix(mixed))


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Smallest product of every multiplier with the set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(values), 512):
        np.minimum(least, (multipliers[:, None] * values[None, begin : begin + 512]).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """Low bits of the mixed minima: plane after plane, each packed and filled up to whole bytes."""
    # The low bits of a product are those of its factors, the same at every position.
    mixed = _mix(least ^ _mix(np.arange(1, len(least) + 1, dtype=np.uint64)))
    return b"".join(np.packbits((mixed >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)).tobytes() for bit in range(BITS))


def estimated(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """Similarities of signatures (rows of bytes): equal positions, corrected for chance."""
    differ = left ^ right
    width = differ.shape[-1] // BITS
    planes = differ.reshape(*differ.shape[:-1], BITS, width)
    any_differs = planes[..., 0, :]
    for bit in range(1, BITS):
        any_differs = any_differs | planes[..., bit, :]
    equal = 1 - np.bitwise_count(any_differs).sum(axis=-1, dtype=np.int64) / count
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def outline(values: np.ndarray) -> bytes:
    """Bit map of the hashes of a set."""
    bits = np.zeros(OUTLINE, np.uint8)
    bits[(values % np.uint64(OUTLINE)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_reach(size: int, one: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set can reach the similarity with others; false only if the outlines rule it out."""
    only_one = np.bitwise_count(one & ~others).sum(axis=-1, dtype=np.int64)
    only_other = np.bitwise_count(others & ~one).sum(axis=-1, dtype=np.int64)
    common = np.minimum(size - only_one, sizes - only_other)
    return 100 * common >= percent * (size + sizes - common)


def least_estimate(percent: int, count: int) -> float:
    """Estimates below this rule a pair out."""
    chance, wanted = 2.0**-BITS, percent / 100
    equal = wanted + (1 - wanted) * chance
    return wanted - SIGMAS * math.sqrt(equal * (1 - equal) / count) / (1 - chance)


PROFILE = "n_shingles long, set_hash binary, bands array<long>, signature binary"


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Replace ``text`` by the set's size, hash, band keys and packed signature."""
    rows, bands = band_shape(percent)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *T.StructType.fromDDL(PROFILE).fields])
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        multipliers = _multipliers(rows * bands)
        for part in slices(batches, "text"):
            out = []
            for text in part.column("text").to_pylist():
                values = shingle_set(text, size)
                if not len(values):
                    out.append((0, b"", [], b""))
                    continue
                least = minima(values, multipliers)
                keys = np.full(bands, 0, np.uint64) + np.arange(bands, dtype=np.uint64)
                for row in least.reshape(bands, rows).T:
                    keys = _mix(keys ^ row) + np.uint64(1)
                out.append((len(values), xxhash.xxh3_128_digest(values.tobytes()), keys.view(np.int64), signature(least)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the texts named by ``wanted`` (``doc_id, text_hash, node``)."""
    few = wanted.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"])

    def run(batches):
        for part in slices(batches, "text"):
            sets = [shingle_set(t, size).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    schema = T.StructType([wanted.schema["node"], T.StructField("shingles", T.BinaryType())])
    return chosen.select("node", "text").mapInArrow(run, schema).dropDuplicates(["node"])


def _outlines(sets: DataFrame) -> DataFrame:
    """``node, outline`` of every set."""

    def run(batches):
        for batch in batches:
            made = [outline(np.frombuffer(b, np.uint64)) for b in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "outline"])

    return sets.mapInArrow(run, T.StructType([sets.schema["node"], T.StructField("outline", T.BinaryType())]))


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs (``a, b``) whose sizes allow the similarity and whose estimate reaches it or does not count."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_allow(percent))
    floor = least_estimate(percent, count)
    kind = pairs.schema["a"].dataType

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = _bytes_of(batch.column("s_a")), _bytes_of(batch.column("s_b"))
                small = batch.column("n").to_numpy() < SMALL
                kept = pa.array(small | (estimated(left, right, count) >= floor))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return sized.select("a", "b", F.least("n_a", "n_b").alias("n"), "s_a", "s_b").mapInArrow(run, schema)


def _sizes_allow(percent: int):
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return low * 100 >= high * percent


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) that reach the similarity on their full sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"x_{name}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    kind = pairs.schema["a"].dataType

    def run(batches):
        for part in slices(batches, "x_a", 8 << 20):
            keep = []
            for x, y in zip(part.column("x_a").to_pylist(), part.column("x_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(kept), part.column("b").filter(kept)], ["a", "b"])

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return both.select("a", "b", "x_a", "x_b").mapInArrow(run, schema)


def _block_pairs(members: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs of different components in one bucket that pass sizes, estimate and outlines.

    A bucket of up to ``BLOCK`` members is compared in one piece; a larger one in
    pairs of blocks, each in a task of its own.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    cut = members.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.hash("node"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    piece = F.struct("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    ordered = cut.select(F.xxhash64(piece).alias("piece"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("inner"),
                         "node", "comp", "n_shingles", "signature", "outline")
    floor = least_estimate(percent, count)
    kind = members.schema["node"].dataType

    def compare(rows: pa.Table):
        nodes, comps = rows.column("node").to_numpy(), rows.column("comp").to_numpy()
        size, bits = rows.column("n_shingles").to_numpy(), _bytes_of(rows.column("signature"))
        outlines = _bytes_of(rows.column("outline"))
        left = rows.column("left").to_numpy(zero_copy_only=False)
        if rows.column("inner")[0].as_py():
            here = there = np.arange(len(nodes))
        else:
            here, there = np.flatnonzero(left), np.flatnonzero(~left)
        for i in here.tolist():
            others = there[there > i] if here is there else there
            low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
            others = others[(comps[others] != comps[i]) & (low * 100 >= high * percent)]
            if len(others):
                small = np.minimum(size[i], size[others]) < SMALL
                others = others[small | (estimated(bits[i], bits[others], count) >= floor)]
                others = others[may_reach(size[i], outlines[i], size[others], outlines[others], percent)]
                for j in others.tolist():
                    yield (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by piece; a piece is complete when the next one begins
            piece = batch.column("piece").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if held and held[0].column("piece")[0].as_py() != piece[begin]:
                    yield _pairs(compare(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield _pairs(compare(pa.Table.from_batches(held).combine_chunks()))

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(tasks, "piece").sortWithinPartitions("piece").mapInArrow(run, schema).distinct()


def _pairs(found) -> pa.RecordBatch:
    a, b = zip(*found) if (found := list(found)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _groups(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows; ``doc_id, node`` of the sets of each id; ``node, comp, doc_id, text_hash``:
    the groups of alike sets, with the first text of each set."""
    rows, bands = band_shape(percent)
    count = rows * bands
    docs = _keyed(docs)
    profile = cut_lineage(profiles(docs, size, percent))
    # Equal sets are one node, numbered by their hashes.
    ids = profile.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "set_hash").agg(F.min("text_hash").alias("text_hash"))
    same = ids.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("set_hash", "first.*")
    same = cut_lineage(rank_rows(same, [], [F.col("set_hash")], "node"))
    firsts = profile.join(same, ["set_hash", "doc_id", "text_hash"])
    nodes = firsts.groupBy("node", "doc_id", "text_hash").agg(
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")
    )
    nodes = cut_lineage(nodes)
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # The first leader is drawn by node alone, so the buckets of a group mostly have the same one.
    first = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("m > 1")
    members = cut_lineage(banded.join(first.drop("m"), "bucket"))
    sets = cut_lineage(_sets(docs, members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"), size))
    slim = nodes.select("node", "n_shingles", "signature")
    labels = nodes.select("node", F.col("node").alias("comp"))
    met = members.where("leader <> node")
    for turn in range(LEADER_ROUNDS + 1):
        pairs = met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        alike = cut_lineage(_alike(pairs, slim, percent, count))
        labels = join_components(labels, _confirmed(alike, sets, percent))
        # Only buckets that hold several components go on.
        placed = members.select("bucket", "node").join(labels, "node")
        drawn = F.min_by(F.struct(F.col("node").alias("leader"), F.col("comp").alias("leader_comp")), F.xxhash64("node", "bucket", F.lit(turn)))
        several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), drawn.alias("lead")).where("low < high")
        members = cut_lineage(placed.join(several.select("bucket", "lead.*"), "bucket"))
        met = members.where("comp <> leader_comp")
    known = slim.join(_outlines(sets), "node")
    pairs = cut_lineage(_block_pairs(members.select("bucket", "node", "comp").join(known, "node"), percent, count))
    labels = join_components(labels, _confirmed(pairs, sets, percent))
    return profile, ids.join(same.select("set_hash", "node"), "set_hash").select("doc_id", "node"), labels.join(nodes.select("node", "doc_id", "text_hash"), "node")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (integer ``doc_id``, ``text``)."""
    profile, sets_of_id, groups = _groups(docs, size, percent)
    # The sets of one id belong together.
    several = sets_of_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    links = sets_of_id.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a < b")
    labels = join_components(groups.select("node", "comp"), links)
    least = groups.select("node", "doc_id").join(labels, "node").groupBy("comp").agg(F.min("doc_id").alias("component"))
    found = sets_of_id.groupBy("doc_id").agg(F.min("node").alias("node")).join(labels, "node").join(least, "comp").select("doc_id", "component")
    component = F.coalesce("component", "doc_id")  # an empty set stands alone
    return profile.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose text is like one of a row before them; rows with a null id stay."""
    profile, _, groups = _groups(docs, size, percent)
    first = groups.groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    empty = profile.where("doc_id IS NOT NULL AND n_shingles = 0").select("doc_id", "text_hash").distinct()
    kept = first.unionByName(empty).select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    names = [f"column_{i}" for i in range(len(docs.columns))]  # none of the names used here
    plain = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    hashed = plain.withColumn("hash", F.xxhash64(text))
    known = hashed.join(kept, (doc_id.cast("long") == F.col("_kept_id")) & (F.col("hash") == F.col("_kept_hash")), "left_semi")
    unordered = (T.MapType, T.VariantType)
    rest = [F.col(n) for n, f in zip(names, docs.schema.fields) if f.name not in ("doc_id", "text") and not isinstance(f.dataType, unordered)]
    order = Window.partitionBy(doc_id, "hash").orderBy(*rest, F.lit(0))
    single = known.withColumn("place", F.row_number().over(order)).where("place = 1").select(*names)
    return single.unionByName(plain.where(doc_id.isNull())).toDF(*docs.columns)


_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    x AS (SELECT doc_id, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
    SELECT doc_id, any_value(n) AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
    FROM r JOIN n USING (doc_id) GROUP BY doc_id"""


@query("op10_minhash_dedup", _SQL)
def op10(spark, sf_dir):
    """Components of documents that share 85 hundredths of their three-word shingles."""
    return classes(table(spark, sf_dir, "documents"), 3, 85)
