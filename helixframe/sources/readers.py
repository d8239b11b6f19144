"""Readers: stores, matrix text, sequences, sites, alignments and side tables.

Record-oriented text is read with a record separator, so one file is split over
many tasks and every record arrives whole in one row.  The ``parse_*`` functions
work on any DataFrame with a ``text`` column, streams included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.operators.ordered import prefix_scan
from helixframe.operators.pieces import PIECE

STORE_SCHEMAS = {
    "matrix": "id bigint, base_id string, version int, collection string, name string, class_no int",
    "matrix_cell": "id string, base string, pos int, val double",
    "matrix_annotation": "id bigint, tag string, val string",
    "tax": "tax_id int, species string",
}
BLOCK_SCHEMA = (
    "block_id bigint, t_name string, t_start bigint, t_end bigint, "
    "q_name string, q_start bigint, q_end bigint, strand string, score bigint"
)
SCORE_SCHEMA = "len1 int, len2 int, mean double, sd double, n bigint, min double, max double"


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a dumped profile store: one tab-separated folder per table."""
    return {
        name: spark.read.schema(schema).csv(f"{path}/{name}", sep="\t", emptyValue="")
        for name, schema in STORE_SCHEMAS.items()
    }


def read_packaged(spark: SparkSession, root: str, pattern: str = r"/([^/]+)\.store/[^/]*$") -> DataFrame:
    """All packaged stores below ``root``; ``store`` is the base name of each package."""
    found = spark.read.option("recursiveFileLookup", True).parquet(root)
    return found.withColumn("store", F.regexp_extract(F.input_file_name(), pattern, 1))


def register_packages(spark: SparkSession, root: str, names: list[str], suffix: str = "store") -> None:
    """Expose each named package as a temporary view under its base name."""
    for name in names:
        spark.read.parquet(f"{root}/{name}.{suffix}").createOrReplaceTempView(name)


def read_records(spark: SparkSession, path: str, separator: str, glob: str | None = None) -> DataFrame:
    """Text records cut at ``separator``, blank ones dropped."""
    reader = spark.read.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (
        reader.text(path)
        .select(F.col("value").alias("text"), F.input_file_name().alias("path"))
        .where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    )


def _lines(text: Column) -> Column:
    cleaned = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.filter(cleaned, lambda line: line != "")


def parse_matrix_text(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four-row count text, plain or ``A [ 1 2 3 ]``, under a ``>id`` line.

    Returns the cells and the rejected records with a reason.
    """
    lines = _lines(F.col("text"))
    split = records.select(
        F.regexp_extract(F.element_at(lines, 1), r"^>?\s*(\S+)", 1).alias("matrix_id"),
        F.transform(
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
            lambda line: F.split(F.trim(F.regexp_replace(line, r"^[ACGTacgt]\b|[\[\]|]", " ")), r"\s+"),
        ).alias("grid"),
    )
    widths = F.array_distinct(F.transform("grid", lambda r: F.size(r)))
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    judged = split.withColumn(
        "reason",
        F.when(F.size("grid") != 4, "not four rows")
        .when(F.size(widths) != 1, "rows differ in width")
        .when(F.exists(F.flatten("grid"), lambda v: ~v.rlike(number)), "not a number"),
    )
    cells = (
        judged.where(F.col("reason").isNull())
        .select("matrix_id", F.posexplode("grid").alias("r", "vals"))
        .select("matrix_id", F.substring(F.lit("ACGT"), F.col("r") + 1, F.lit(1)).alias("base"), F.posexplode("vals").alias("p", "v"))
        .select("matrix_id", (F.col("p") + 1).alias("pos"), "base", F.col("v").cast("double").alias("n"))
    )
    return cells, judged.where(F.col("reason").isNotNull()).select("matrix_id", "reason")


def read_matrix_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_matrix_text(read_records(spark, path, ">"))


def parse_transfac(records: DataFrame) -> DataFrame:
    """``DE id [name] [class]`` records with one numbered line per column, as cells."""
    lines = _lines(F.col("text"))
    head = F.split(F.element_at(F.filter(lines, lambda line: line.startswith("DE")), 1), " ")
    body = F.filter(lines, lambda line: line.rlike(r"^\d+ "))
    rows = records.select(
        F.element_at(head, 2).alias("matrix_id"),
        F.try_element_at(head, F.lit(3)).alias("family"),
        F.posexplode(body).alias("p", "line"),
    ).withColumn("v", F.split("line", " "))
    return rows.select(
        "matrix_id",
        "family",
        (F.col("p") + 1).alias("pos"),
        F.inline(
            F.array(*[
                F.struct(F.lit(b).alias("base"), F.element_at("v", i + 2).cast("double").alias("n"))
                for i, b in enumerate("ACGT")
            ])
        ),
    )


def read_transfac(spark: SparkSession, path: str) -> DataFrame:
    return parse_transfac(read_records(spark, path, "XX\n"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """``header`` and upper-case ``seq`` without blanks and digits."""
    head = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), "^>", ""))
    body = F.when(F.col("text").contains("\n"), F.expr("substr(text, locate('\\n', text) + 1)")).otherwise("")
    return records.select(
        F.substring_index(head, " ", 1).alias("header"),
        F.upper(F.regexp_replace(body, r"[\s\d]", "")).alias("seq"),
        *([F.col("path")] if "path" in records.columns else []),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(read_records(spark, path, ">"))


def read_fasta_pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """``path, record, header, offset, text``: FASTA sequences in pieces of ``size`` letters.

    Files are read line by line and no record is ever held: header marks and letters
    before a line are running values over the lines of a file, and the parts of lines
    that fall into one piece are put together.  ``record`` counts the headers of a file
    from 1; lines before the first one are left out, and so are records without letters.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    head = F.col("value").startswith(">")
    told = lines.select(
        "path", "_block", "_at", head.cast("int").alias("_head"),
        F.when(head, F.substring_index(F.trim(F.substring(F.col("value"), F.lit(2), F.length("value"))), " ", 1)).alias("_name"),
        F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"[\s\d]", ""))).alias("_text"),
    ).withColumn("_n", F.length("_text").cast("bigint"))
    order = [F.col("_block"), F.col("_at")]
    counted = prefix_scan(told, ["path"], order, keep_range=True, record=("sum", "_head"), _upto=("sum", "_n"))
    marked = counted.withColumn("_mark", F.when(F.col("_head") == 1, F.col("_upto")))
    placed = prefix_scan(marked, ["path"], order, header=("last", "_name"), _base=("last", "_mark")).where("_n > 0 AND record > 0")
    begin = F.col("_upto") - F.col("_n") - F.col("_base")
    parts = placed.withColumn("_begin", begin).withColumn(
        "_piece", F.explode(F.sequence(F.floor(begin / size), F.floor((begin + F.col("_n") - 1) / size)))
    )
    skipped = F.greatest(F.col("_piece") * size - F.col("_begin"), F.lit(0))
    length = F.least((F.col("_piece") + 1) * size, F.col("_begin") + F.col("_n")) - F.greatest(F.col("_piece") * size, F.col("_begin"))
    cut = parts.withColumn("_part", F.substring(F.col("_text"), (skipped + 1).cast("int"), length.cast("int")))
    joined = cut.groupBy("path", "record", "header", "_piece").agg(F.array_sort(F.collect_list(F.struct("_begin", "_part"))).alias("_p"))
    return joined.select(
        "path", "record", "header", (F.col("_piece") * size).alias("offset"), F.array_join(F.transform("_p", lambda x: x["_part"]), "").alias("text")
    )


def read_sites(spark: SparkSession, path: str, id_pattern: str = r"/([^/]+)\.sites(?:/[^/]*)?$") -> DataFrame:
    """Site files; the id is the file name without suffix and unknown letters become N."""
    records = read_records(spark, path, ">")
    body = F.regexp_replace(F.expr("substr(text, locate('\\n', text) + 1)"), r"\s", "")
    return records.select(
        F.regexp_extract("path", id_pattern, 1).alias("matrix_id"),
        F.trim(F.substring_index("text", "\n", 1)).alias("header"),
        F.translate(body, "Xx", "Nn").alias("site"),
    )


def parse_alignment(records: DataFrame) -> DataFrame:
    """Blocks of ``name chunk`` lines for two sequences, joined per name.

    Letters that are not word characters become ``-``.
    """
    rows = F.filter(_lines(F.col("text")), lambda line: line.rlike(r"^\S+ \S+$") & ~line.startswith("CLUSTAL"))
    names = F.array_distinct(F.transform(rows, lambda line: F.substring_index(line, " ", 1)))
    held = records.select(rows.alias("rows"), names.alias("names"))

    def joined(i: int) -> Column:
        own = F.filter("rows", lambda line: F.substring_index(line, " ", 1) == F.element_at("names", i))
        text = F.array_join(F.transform(own, lambda line: F.substring_index(line, " ", -1)), "")
        return F.regexp_replace(text, r"\W", "-")

    return held.where(F.size("names") >= 2).select(
        F.element_at("names", 1).alias("name1"),
        joined(1).alias("seq1"),
        F.element_at("names", 2).alias("name2"),
        joined(2).alias("seq2"),
    )


def read_alignment(spark: SparkSession, path: str, separator: str = "//\n") -> DataFrame:
    return parse_alignment(read_records(spark, path, separator))


def read_seq_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, size bigint").csv(path, sep=" ")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).csv(path, sep="\t")


def read_score_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).csv(path, sep="\t")


def parse_collections(lines: DataFrame) -> DataFrame:
    """``START_ENTRY`` / ``KEY<TAB>value`` / ``END_ENTRY`` lines of a file, in ``line_no`` order."""
    kept = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    marked = kept.withColumn("_start", (F.col("line") == "START_ENTRY").cast("int"))
    numbered = prefix_scan(marked, ["path"], [F.col("line_no")], entry=("sum", "_start"))
    pairs = numbered.where(F.col("line").contains("\t")).select(
        "path",
        "entry",
        "line_no",
        F.substring_index("line", "\t", 1).alias("key"),
        F.substring_index(F.substring_index("line", "\t", 2), "\t", -1).alias("val"),
    )
    latest = pairs.groupBy("path", "entry").pivot("key", ["COLLECTION", "DESCRIPTION", "BROWSE_KEYS", "POP_UP_KEYS"]).agg(
        F.max_by("val", "line_no")
    )
    return latest.select(
        F.col("COLLECTION").alias("collection"),
        F.col("DESCRIPTION").alias("description"),
        F.split("BROWSE_KEYS", ",").alias("browse_keys"),
        F.split("POP_UP_KEYS", ",").alias("pop_up_keys"),
    )


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections file, one row per entry.  Entries are cut by their end mark, so
    line numbers inside an entry give the order in which repeated keys override."""
    entries = read_records(spark, path, "END_ENTRY\n").withColumn("path", F.concat("path", F.lit("#"), F.md5("text")))
    lines = entries.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return parse_collections(lines)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()
