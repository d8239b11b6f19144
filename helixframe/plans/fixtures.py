"""Domain tables derived from the provided Parquet files, once per engine.

``Fixtures`` builds them as DataFrames; ``ORACLE_VIEWS`` states the same tables
as SQL text for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from helixframe.operators import pieces
from helixframe.operators.ordered import prefix_scan, rank_rows
from helixframe.session import cut_lineage, task_count

#: Widest site of a set.
SITE_WIDTH = 12


def _part_begins(parts: Column) -> Column:
    """Where each part of a cut text begins, from 1."""
    return F.aggregate(
        parts, F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("next")),
        lambda seen, part: F.struct(F.concat(seen["at"], F.array(seen["next"])).alias("at"), (seen["next"] + F.length(part)).alias("next")),
        lambda seen: seen["at"],
    )


#: The letters of a sequence, as capitals; 0 for all other bytes of a text.
_BASES = np.zeros(256, np.uint8)
_BASES[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"ACGTACGT", np.uint8)
#: Positions of alignments in one Arrow batch.
_BATCH = 1 << 17


@F.arrow_udf(T.StringType())
def _capitals(text: pa.Array) -> pa.Array:
    text = text.cast(pa.string())
    ends = np.frombuffer(text.buffers()[1] or bytes(4), np.int32)[text.offset:text.offset + len(text) + 1]
    found = _BASES[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]]
    kept = np.flatnonzero(found)
    begins = np.searchsorted(kept, ends - ends[0]).astype(np.int32)
    letters = pa.StringArray.from_buffers(len(text), pa.py_buffer(begins), pa.py_buffer(found[kept]))
    return pc.if_else(text.is_valid(), letters, pa.scalar(None, pa.string()))


def bases(text: str) -> Column:
    """The letters A, C, G and T of texts, as capitals."""
    # A filter on the letters would otherwise be moved below and work them out once more.
    return _capitals.asNondeterministic()(text)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two texts letter by letter as far as both go, with gaps and mismatches where place and number say so."""
    for batch in batches:
        size = np.minimum(*(pc.binary_length(batch.column(c)).to_numpy() for c in ("s1", "s2")))
        share = np.cumsum(size) // _BATCH
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            part, n = batch.slice(low, high - low), size[low:high]
            if not n.sum():
                continue
            own, other = (
                np.frombuffer("".join(x[:k] for x, k in zip(part.column(c).to_pylist(), n.tolist())).encode(), np.uint8) for c in ("s1", "s2")
            )
            row = np.repeat(np.arange(len(n)), n)
            aln = part.column("aln_id").to_numpy()[row]
            apos = part.column("offset").to_numpy()[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row] + 1
            gap1, gap2 = (apos * 7 + aln) % 17 == 0, (apos * 5 + aln) % 19 == 0
            first = np.where(gap1, 45, own).astype(np.uint8)
            second = np.where(gap2 & ~gap1, 45, np.where((apos * 11 + aln) % 3 == 0, other, own)).astype(np.uint8)
            at = pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32))
            c1, c2 = (pa.StringArray.from_buffers(len(row), at, pa.py_buffer(x)) for x in (first, second))
            yield pa.RecordBatch.from_arrays([pa.array(aln), pa.array(apos.astype(np.int32)), c1, c2], ["aln_id", "apos", "c1", "c2"])


class Fixtures:
    """Derived tables of one scale-factor folder, for one query.  Building a table runs no
    job, except for the sequences and the three tables that number rows over an ordering."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # Intermediate results that a plan reads more than once.
        self.kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sequence(self) -> DataFrame:
        """Letters of every text.  Written once, evenly, because a plan may read it
        several times and filtering the text is the dearest part of reading it."""
        letters = self.table("documents").select(
            F.col("doc_id").alias("seq_id"),
            "source",
            "lang",
            bases("text").alias("seq"),
        )
        return cut_lineage(letters.repartition(task_count(self.spark), "seq_id"))

    @cached_property
    def letters(self) -> DataFrame:
        """How many letters every text has; the letters themselves are not kept."""
        count = F.length(bases("text")).cast("bigint")
        return self.table("documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("seq_id"), count.alias("length"))

    @cached_property
    def pieces(self) -> DataFrame:
        """The same letters in pieces, with source and language."""
        letters = self.table("documents").select(
            F.col("doc_id").alias("seq_id"), "source", "lang", bases("text").alias("seq")
        )
        return cut_lineage(pieces.cut(letters).repartition(task_count(self.spark), "seq_id", "offset"))

    @cached_property
    def site(self) -> DataFrame:
        """Binding sites of a set: all places in all its sequences where its seed of three
        letters stands, with the letters that follow up to the set's width."""
        number = F.substring("source", 4, 10).cast("int")
        letter = lambda n: F.substring(F.lit("ACGT"), F.pmod(n, F.lit(4)) + 1, F.lit(1))
        sets = self.table("documents").select(
            F.col("source").alias("matrix_id"), F.col("doc_id").alias("seq_id"), (6 + number % 7).alias("w"),
            F.concat(letter(number), letter(F.floor(number / 4)), letter(F.floor(number / 8) + number)).alias("seed"),
        )
        places = pieces.tiles(self.pieces, SITE_WIDTH - 1, 512).join(sets, "seq_id").where(F.length("text") >= F.col("w"))
        # Cut before every place of the seed; what lies before a part is how far the place is in.
        parts = F.split(F.col("text"), F.concat(F.lit("(?="), F.col("seed"), F.lit(")")))
        found = places.select("*", F.explode(_part_begins(parts)).alias("i")).where(F.col("text").substr(F.col("i"), F.lit(3)) == F.col("seed")).where(
            (F.col("i") <= F.col("own")) & (F.col("i") + F.col("w") - 1 <= F.length("text"))
        )
        return found.select(
            "matrix_id", "seq_id", (F.col("offset") + F.col("i")).alias("site_at"), F.substring(F.col("text"), F.col("i"), F.col("w")).alias("site")
        )

    @cached_property
    def cell(self) -> DataFrame:
        letters = self.site.select("matrix_id", F.posexplode(F.split("site", "")).alias("p", "base"))
        return (
            letters.groupBy("matrix_id", (F.col("p") + 1).alias("pos"), "base")
            .agg(F.count(F.lit(1)).cast("double").alias("n"))
        )

    @cached_property
    def matrix(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_brand").alias("base_id"),
            F.col("p_type").alias("collection"),
            F.col("p_name").alias("name"),
            F.col("p_size").cast("int").alias("class_no"),
        )
        ranked = rank_rows(part, ["base_id"], [F.col("id")], "version")
        return ranked.select("id", "base_id", F.col("version").cast("int").alias("version"), "collection", "name", "class_no")

    @cached_property
    def species(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("l_partkey").alias("id"), F.col("s_nationkey").alias("tax_id"))
            .distinct()
        )

    @cached_property
    def tax(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("tax_id"), F.col("n_name").alias("species"), F.col("r_name").alias("tax_group"))
        )

    @cached_property
    def block(self) -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        items = self.table("lineitem").select(*order, "l_quantity", "l_returnflag")
        ranked = rank_rows(items, [], [F.col(c) for c in order], "block_id")
        t_start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 10
        q_start = F.col("l_orderkey") * 10
        size = F.col("l_quantity").cast("bigint")
        return ranked.select(
            "block_id",
            F.concat(F.lit("t"), (F.col("l_suppkey") % 5).cast("string")).alias("t_name"),
            t_start.alias("t_start"),
            (t_start + size).alias("t_end"),
            F.concat(F.lit("q"), (F.col("l_partkey") % 3).cast("string")).alias("q_name"),
            q_start.alias("q_start"),
            (q_start + size).alias("q_end"),
            F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
            F.floor("l_extendedprice").cast("bigint").alias("score"),
        )

    @cached_property
    def size(self) -> DataFrame:
        return self.table("documents").select(
            F.col("source").alias("genome"), F.col("doc_id").alias("seq_id"), F.col("n_chars").alias("size")
        )

    @cached_property
    def alignment_text(self) -> DataFrame:
        """Pieces of the two texts of every alignment, a document and the next one of its source; written once."""
        before = prefix_scan(
            self.table("documents").select(F.col("doc_id").alias("next_id"), "source"),
            ["source"],
            [F.col("next_id")],
            aln_id=("lag", "next_id"),
        )
        links = cut_lineage(before.where(F.col("aln_id").isNotNull()).select("aln_id", "next_id"))
        own, other = (
            self.pieces.select(F.col("seq_id").alias(name), "offset", F.col("text").alias(text)) for name, text in (("aln_id", "s1"), ("next_id", "s2"))
        )
        return cut_lineage(links.join(own, "aln_id").join(other, ["next_id", "offset"]).select("aln_id", "offset", "s1", "s2"))

    @cached_property
    def alignment_made(self) -> tuple[DataFrame, Callable]:
        """What the alignments are made of: pieces of both texts at the same offset, and how."""
        dealt = self.alignment_text.repartition(task_count(self.spark), "aln_id", "offset")
        return dealt.select(F.col("aln_id").cast("bigint"), F.col("offset").cast("bigint"), "s1", "s2"), _aligned

    @cached_property
    def alignment(self) -> DataFrame:
        """Both texts letter by letter as far as both go."""
        source, maker = self.alignment_made
        return source.mapInArrow(maker, "aln_id bigint, apos int, c1 string, c2 string")

    @cached_property
    def log(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("file_id"), F.col("turn").alias("line_no"), F.col("role").alias("line")
        )

    @cached_property
    def gene(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("acc"),
            F.col("source").alias("gene_id"),
            F.col("lang").alias("species"),
            F.col("text").alias("description"),
        )

    @cached_property
    def feature(self) -> DataFrame:
        start = F.floor("value").cast("bigint") + 1
        return self.table("events").select(
            F.col("event_id").alias("feature_id"),
            F.col("user_id").alias("seq_id"),
            F.when(F.col("event_type").isin("purchase", "signup"), "exon")
            .when(F.col("event_type") == "error", "orf")
            .otherwise("other")
            .alias("kind"),
            start.alias("f_start"),
            (start + F.col("event_id") % 50).alias("f_end"),
            F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("strand"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        return (
            self.table("documents")
            .join(self.table("labels"), "doc_id")
            .select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
        )

    @cached_property
    def protein(self) -> DataFrame:
        """Consecutive rows of ten residues over every text; the last one may be shorter."""
        residues = F.upper(F.regexp_replace("text", "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]+", ""))
        return self.table("documents").select(
            F.col("source").alias("member"),
            F.col("doc_id").alias("row_id"),
            F.posexplode(F.regexp_extract_all(residues, F.lit("(.{1,10})"), F.lit(1))).alias("part", "aligned"),
        )


ORACLE_VIEWS: dict[str, str] = {
    "f1_sequence": """SELECT doc_id AS seq_id, source, lang,
        upper(regexp_replace(text,'[^ACGTacgt]','','g')) AS seq FROM documents""",
    "f2_site": """SELECT matrix_id, seq_id, CAST(site_at AS BIGINT) AS site_at, substr(seq, CAST(site_at AS INT), w) AS site FROM
        (SELECT matrix_id, seq_id, seq, 6+k%7 AS w, unnest(range(1, length(seq)-(6+k%7)+2)) AS site_at,
           substr('ACGT',k%4+1,1) || substr('ACGT',(k//4)%4+1,1) || substr('ACGT',(k//8+k)%4+1,1) AS seed FROM
          (SELECT source AS matrix_id, seq_id, seq, CAST(substr(source,4) AS INT) AS k FROM f1_sequence))
        WHERE substr(seq, CAST(site_at AS INT), 3)=seed""",
    "f3_cell": """SELECT matrix_id, CAST(pos AS INT) AS pos, substr(site,CAST(pos AS INT),1) AS base,
        CAST(count(*) AS DOUBLE) AS n
        FROM (SELECT matrix_id, site, unnest(range(1,length(site)+1)) AS pos FROM f2_site) GROUP BY 1,2,3""",
    "f4_matrix": """SELECT p_partkey AS id, p_brand AS base_id,
        CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS version,
        p_type AS collection, p_name AS name, CAST(p_size AS INT) AS class_no FROM part""",
    "f4_species": """SELECT DISTINCT l_partkey AS id, s_nationkey AS tax_id
        FROM lineitem JOIN supplier ON l_suppkey=s_suppkey""",
    "f4_tax": """SELECT n_nationkey AS tax_id, n_name AS species, r_name AS tax_group
        FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "f5_block": """SELECT CAST(row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate)
        AS BIGINT) AS block_id, concat('t',CAST(l_suppkey%5 AS STRING)) AS t_name,
        l_partkey*100+l_linenumber*10 AS t_start, l_partkey*100+l_linenumber*10+CAST(l_quantity AS BIGINT) AS t_end,
        concat('q',CAST(l_partkey%3 AS STRING)) AS q_name, l_orderkey*10 AS q_start,
        l_orderkey*10+CAST(l_quantity AS BIGINT) AS q_end,
        CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand,
        CAST(floor(l_extendedprice) AS BIGINT) AS score FROM lineitem""",
    "f6_size": "SELECT source AS genome, doc_id AS seq_id, n_chars AS size FROM documents",
    "f7_alignment": """SELECT aln_id, apos,
        CASE WHEN (apos*7+aln_id)%17=0 THEN '-' ELSE substr(s1,apos,1) END AS c1,
        CASE WHEN (apos*5+aln_id)%19=0 AND (apos*7+aln_id)%17<>0 THEN '-'
             WHEN (apos*11+aln_id)%3=0 THEN substr(s2,apos,1) ELSE substr(s1,apos,1) END AS c2
        FROM (SELECT aln_id, s1, s2, CAST(unnest(range(1,len+1)) AS INT) AS apos FROM
          (SELECT aln_id, s1, s2, least(length(s1),length(s2)) AS len FROM
            (SELECT seq_id AS aln_id, seq AS s1, lead(seq) OVER (PARTITION BY source ORDER BY seq_id) AS s2 FROM f1_sequence)
           WHERE s2 IS NOT NULL))""",
    "f8_log": "SELECT conv_id AS file_id, turn AS line_no, role AS line FROM conversations",
    "f9_gene": """SELECT doc_id AS acc, source AS gene_id, lang AS species, text AS description
        FROM documents""",
    "f10_feature": """SELECT event_id AS feature_id, user_id AS seq_id,
        CASE WHEN event_type IN ('purchase','signup') THEN 'exon' WHEN event_type='error' THEN 'orf' ELSE 'other' END AS kind,
        CAST(floor(value) AS BIGINT)+1 AS f_start, CAST(floor(value) AS BIGINT)+1+event_id%50 AS f_end,
        CASE WHEN event_id%2=0 THEN 1 ELSE -1 END AS strand FROM events""",
    "f11_scored": """SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label
        FROM documents d JOIN labels l USING (doc_id)""",
    "f12_protein": """SELECT member, row_id, CAST(part AS INT) AS part, substr(residues, CAST(part*10+1 AS INT), 10) AS aligned FROM
        (SELECT member, row_id, residues, unnest(range(0, (length(residues)+9)//10)) AS part FROM
          (SELECT source AS member, doc_id AS row_id,
             upper(regexp_replace(text,'[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]','','g')) AS residues FROM documents))""",
}
