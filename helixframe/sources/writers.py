"""Writers and print formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.profiles import BASES

FORMATS = ("raw", "bracketed", "transfac")


def dump_table(df: DataFrame, path: str, order: str = "id") -> None:
    """Tab-separated dump in id order."""
    df.orderBy(order).write.csv(path, sep="\t", emptyValue="")


def _number(value: Column) -> Column:
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("bigint"))).otherwise(value.cast("string"))


def format_matrices(counts: DataFrame, form: str = "raw") -> DataFrame:
    """One printed matrix per row of the result, from the wide count table."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    columns = F.array_sort(F.collect_list(F.struct("pos", *BASES)))
    packed = counts.groupBy("matrix_id").agg(columns.alias("cols"))

    def row(base: str) -> Column:
        return F.array_join(F.transform("cols", lambda c: _number(c[base])), " ")

    if form == "raw":
        text = F.concat_ws("\n", *[row(b) for b in BASES])
    elif form == "bracketed":
        text = F.concat_ws("\n", *[F.concat(F.lit(f"{b.upper()} ["), row(b), F.lit("]")) for b in BASES])
    else:
        lines = F.transform(
            "cols", lambda c: F.concat_ws(" ", (c["pos"] - 1).cast("string"), *[_number(c[b]) for b in BASES])
        )
        text = F.concat_ws("\n", F.concat(F.lit("DE "), "matrix_id"), F.array_join(lines, "\n"), F.lit("XX"))
    return packed.select("matrix_id", text.alias("text"))


def write_matrix_text(counts: DataFrame, path: str, form: str = "raw") -> None:
    """One text data set of printed matrices in id order, headed by ``>id`` unless TRANSFAC."""
    printed = format_matrices(counts, form).orderBy("matrix_id")
    head = F.lit("") if form == "transfac" else F.concat(F.lit(">"), F.col("matrix_id"), F.lit("\n"))
    printed.select(F.concat(head, F.col("text")).alias("value")).write.text(path)


def write_matrix_dir(counts: DataFrame, path: str) -> None:
    """One folder of text per matrix."""
    format_matrices(counts, "raw").select("matrix_id", F.col("text").alias("value")).repartition("matrix_id").write.partitionBy(
        "matrix_id"
    ).text(path)


def fasta_text(header: Column, seq: Column, width: int = 60) -> Column:
    """A FASTA record with lines of ``width`` letters."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(pieces: DataFrame, header: Column, path: str, width: int = 60) -> None:
    """FASTA text of sequences in pieces; a record is written piece by piece by one task, in order."""
    lines = F.regexp_replace("text", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.when(F.col("offset") == 0, F.concat(F.lit(">"), header, F.lit("\n"))).otherwise("")
    ordered = pieces.select("seq_id", "offset", F.concat(head, lines).alias("value")).repartitionByRange("seq_id")
    ordered.sortWithinPartitions("seq_id", "offset").select("value").write.text(path)


def alignment_rows(alignments: DataFrame, width: int = 60) -> DataFrame:
    """Blocks of ``width`` columns of two gapped strings ``seq1`` and ``seq2``."""
    count = F.ceil(F.length("seq1") / width).cast("int")
    blocks = alignments.where(F.length("seq1") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), count - 1)).alias("block_no")
    )
    start = F.col("block_no") * width + 1
    return blocks.withColumn("row1", F.substring(F.col("seq1"), start, F.lit(width))).withColumn(
        "row2", F.substring(F.col("seq2"), start, F.lit(width))
    )


def write_alignment(alignments: DataFrame, path: str, width: int = 60) -> None:
    """Alignments ``(name1, seq1, name2, seq2)`` as blocks of lines, each closed by ``//``."""

    def lines(i: Column) -> Column:
        start = i * width + 1
        return F.concat_ws(
            "\n",
            F.concat_ws(" ", "name1", F.substring(F.col("seq1"), start, F.lit(width))),
            F.concat_ws(" ", "name2", F.substring(F.col("seq2"), start, F.lit(width))),
            F.lit(""),
        )

    count = F.greatest(F.ceil(F.length("seq1") / width).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lines)
    alignments.select(F.concat(F.array_join(blocks, "\n"), F.lit("\n//")).alias("value")).write.text(path)


def write_names(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).distinct().orderBy("value").write.text(path)
