"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern and every match is merged by itself.
The merges of a match run on a segment tree over its byte positions: a leaf
holds the rank of the pair that starts there, an inner node the leftmost
minimum below it.  The root names the next merge; a merge touches three leaves
(the merged position, the one it swallowed, the live neighbour on the left), so
it costs a logarithmic number of node updates.  Matches of up to
``BATCH_BYTES`` bytes run through the trees of many matches at once as arrays,
longer ones through one tree on lists; both follow the same steps.

The ids of a match do not depend on where it stands, so each worker keeps those
of the matches it has met, up to ``CACHE_ENTRIES``, in two halves: when the newer
one is full it becomes the older one, and what is not met again goes with it.

Results: a null text counts as empty; an empty text has no ids.  Decoding skips
null ids and ids outside the vocabulary; a null id list decodes to no bytes.
Lone surrogates cannot occur in Spark strings.  Rows are handled one by one, so
ties and repeated rows give equal values, an empty table an empty result, and
all other columns pass through; ``ids`` and ``decoded`` replace columns of
those names.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from helixframe.llm.common import query, slices, table, texts_of

BATCH_BYTES = 64
CACHE_ENTRIES = 300_000
_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> tuple[bytes, str]:
    """Content of the rank file and its split pattern, read on the driver (under 1 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


class Vocabulary:
    """Token bytes by id, and the rank of every pair of tokens whose join is a token."""

    def __init__(self, ranks: bytes):
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = max(self.rank.values()) + 1
        self.tokens = [b""] * (size + 1)  # the last stands for every id outside the vocabulary
        for token, rank in self.rank.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_ids = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        # Pairs of single bytes, which every match begins with, by a table.
        self.byte_pairs = self.pair_rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where the join is no token."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], _NONE)


def merge_one(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one match, by a segment tree on a list."""
    n, pairs = len(data), vocabulary.pairs
    width = 1 << max(0, n - 1).bit_length()
    ids = vocabulary.byte_ids[np.frombuffer(data, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = (1 << 62, 0)
    # Tuples (rank, position) compare by rank first, so the minimum is the leftmost one.
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[width + i] = (rank, i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(position, value):
        node = width + position
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    def pair_at(position):
        follower = after[position]
        rank = pairs.get(ids[position] << 32 | ids[follower]) if follower < n else None
        return none if rank is None else (rank, position)

    while tree[1] != none:
        rank, here = tree[1]
        gone = after[here]
        ids[here], after[here] = rank, after[gone]
        if after[here] < n:
            before[after[here]] = here
        ids[gone] = -1
        put(gone, none)
        put(here, pair_at(here))
        if before[here] >= 0:
            put(before[here], pair_at(before[here]))
    return [i for i in ids if i >= 0]


def merge_many(data: list[bytes], width: int, vocabulary: Vocabulary) -> list[bytes]:
    """Ids (32 bits each) of matches of at most ``width`` bytes (a power of two), all trees side by side."""
    rows = len(data)
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(rows, width)
    # One spare column holds reads and writes beyond the end.
    ids = np.concatenate([vocabulary.byte_ids[raw], np.zeros((rows, 1), np.int64)], axis=1)
    after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
    before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
    position = np.arange(width)
    after[:, :width] = np.where(position + 1 < sizes[:, None], after[:, :width], width)
    alive = position < sizes[:, None]
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    bytes_ = raw.astype(np.int64)
    ranks = vocabulary.byte_pairs[bytes_[:, : width - 1] << 8 | bytes_[:, 1:]]
    live = (position[:-1] + 1 < sizes[:, None]) & (ranks != _NONE)
    # rank * width + position: the minimum is the leftmost pair of least rank.
    tree[:, width : 2 * width - 1] = np.where(live, ranks * width + position[:-1], _NONE)
    step = width // 2
    while step:
        tree[:, step : 2 * step] = np.minimum(tree[:, 2 * step : 4 * step : 2], tree[:, 2 * step + 1 : 4 * step : 2])
        step //= 2
    # The same arrays in one row each: places are taken by one index.
    nodes, ids_at, after_at, before_at = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)

    def put(row, place, value):
        base, node, at = row * (2 * width), width + place, width
        nodes[base + node] = value
        while at > 1:
            at, node = at >> 1, node >> 1
            below = base + 2 * node
            nodes[base + node] = np.minimum(nodes[below], nodes[below + 1])

    def pair_at(row, place):
        base = row * (width + 1)
        follower = after_at[base + place]
        value = np.full(len(row), _NONE)
        some = np.flatnonzero(follower < width)
        rank = vocabulary.pair_rank(ids_at[base[some] + place[some]], ids_at[base[some] + follower[some]])
        value[some] = np.where(rank == _NONE, _NONE, np.where(rank == _NONE, 0, rank) * width + place[some])
        return value

    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        low = nodes[row * (2 * width) + 1]
        here = low % width
        base = row * (width + 1)
        gone = after_at[base + here]
        ids_at[base + here] = low // width
        follower = after_at[base + gone]
        after_at[base + here] = follower
        before_at[base + follower] = here
        alive[row, gone] = False
        put(row, gone, _NONE)
        put(row, here, pair_at(row, here))
        left = before_at[base + here]
        some = np.flatnonzero(left >= 0)
        if len(some):
            put(row[some], left[some], pair_at(row[some], left[some]))
        row = row[nodes[row * (2 * width) + 1] != _NONE]
    sizes = 4 * alive.sum(axis=1)
    flat = ids[:, :width][alive].astype("<i4").tobytes()
    ends = np.cumsum(sizes).tolist()
    return [flat[end - size : end] for end, size in zip(ends, sizes.tolist())]


class Encoder:
    """Vocabulary, split pattern and the matches met so far."""

    def __init__(self, ranks: bytes, pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids of 32 bits each
        self.older: dict[str, bytes] = {}

    def learn(self, matches: list[str]) -> None:
        if len(self.known) + len(matches) > CACHE_ENTRIES // 2:
            self.older, self.known = self.known, {}
        again = {m: self.older[m] for m in matches if m in self.older}
        if again:
            self.known.update(again)
            matches = [m for m in matches if m not in again]
        data = [m.encode("utf-8", "replace") for m in matches]
        whole = list(map(self.vocabulary.rank.get, data))
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        # Tokens are known as they are; the others by the least power of two that holds their bytes.
        width = np.where(sizes > BATCH_BYTES, -1, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        width[[rank is not None for rank in whole]] = 0
        for w in np.unique(width).tolist():
            members = np.flatnonzero(width == w).tolist()
            for begin in range(0, len(members), 8192):
                part = members[begin : begin + 8192]
                if w == 0:
                    ids = [whole[i].to_bytes(4, "little") for i in part]
                elif w < 0:
                    ids = [np.array(merge_one(data[i], self.vocabulary), "<i4").tobytes() for i in part]
                else:
                    ids = merge_many([data[i] for i in part], w, self.vocabulary)
                self.known.update(zip([matches[i] for i in part], ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        # No cycles are made here, and the collector would walk the long lists again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) for t in texts]
        matches = list(chain.from_iterable(split))
        found = list(map(self.known.get, matches))
        if None in found:
            places = [i for i, ids in enumerate(found) if ids is None]
            fresh = list({matches[i] for i in places})
            self.learn(fresh)
            for i in places:
                found[i] = self.known[matches[i]]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<i4")
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum([len(s) for s in split])
        return ids, np.diff(np.concatenate([[0], upto[ends]]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the bytes that each id gives."""
        v = self.vocabulary
        outside = len(v.tokens) - 1
        ids = np.where((ids >= 0) & (ids < outside), ids, outside)
        lengths = v.lengths[ids]
        ends = np.cumsum(lengths)
        shift = v.starts[ids] - (ends - lengths)
        place = np.repeat(shift, lengths)
        place += np.arange(len(place))
        return v.blob[place], lengths


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The worker's encoder of a vocabulary; built once per worker process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary: tuple[bytes, str] | None = None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``ids`` (array of int); the text itself is dropped unless ``keep_text``."""
    ranks, pattern = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary, under 1 MB
    kept = [f for f in docs.schema.fields if f.name != "ids" and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches):
        work = encoder(shared.value, pattern)
        for part in slices(batches, text):
            ids, counts = work.encode(texts_of(part, text))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], lists], [*names, "ids"])

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, vocabulary: tuple[bytes, str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary), the bytes of ``ids``."""
    ranks, pattern = vocabulary or default_vocabulary()
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in tokens.schema.fields if f.name != "decoded"]
    names = [f.name for f in kept]

    def run(batches):
        work = encoder(shared.value, pattern)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(counts)
            begin = 0
            while begin < batch.num_rows:  # about a million ids at a time
                before = ends[begin] - counts[begin]
                end = max(begin + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
                part = batch.slice(begin, end - begin)
                ids = part.column("ids").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                data, lengths = work.decode(ids)
                upto = np.concatenate([[0], np.cumsum(lengths)])
                offsets = upto[np.concatenate([[0], np.cumsum(counts[begin:end])])].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], decoded], [*names, "decoded"])
                begin = end

    return tokens.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    """Ids and round trip of every document, as digests."""
    vocabulary = default_vocabulary()
    tokens = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
