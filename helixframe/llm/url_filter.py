"""URL filters as a sort-merge range join.

The canonical key of a rule is its host with the labels reversed, a slash, and
its path: ``org.example//es/``.  Everything the rule covers on one host has a key
that starts with it, so a rule is an interval of keys, and intervals are nested
or disjoint.  As a rule also covers subdomains, a URL asks once per parent
domain that is no deeper than the deepest rule.  Rules and questions are
sorted together by key; a sweep keeps the stack of rules that are open, and the
top of the stack is the longest one that covers a question.

The sorted sequence is cut at bounds taken from a small sample of the
questions; bounds contain a hash of the URL, so that even one key asked by very
many hosts is split.  A rule goes to every piece its interval touches, which are
few: the rules open at a bound are nested.  The bounds decide only where rows
go, never the result.  Equal URLs are judged once.

Results: a null URL or one without ``://`` has an empty host and path, which only
a rule with empty host covers.  Among the rules that fit, the longest host and
path together win, then the longer host; of equal rules ``block`` wins.  Rules
with a null host are ignored, a null path is empty.  URLs that no rule fits get
the default verdict and a null rule.  Repeated rows are answered one by one;
empty tables give empty results, no rules give the default everywhere.  Other
columns pass through; ``host, path, rule, verdict`` are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.llm.common import query, table
from helixframe.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
DEFAULT = "allow"
#: Sampled questions for each piece of the sorted sequence.
SAMPLES = 16
#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + "/" + path


def _salt(host: str, path: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}/{path}") >> 1


def _questions(host: str, path: str, depth: int):
    """Keys under which a URL may be covered: its parent domains of up to ``depth`` labels."""
    labels = host.split(".")[::-1]
    return [".".join(labels[:n]) + "/" + path for n in range(1, min(len(labels), depth) + 1)]


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add ``host, path, rule, verdict``; ``rules`` has ``host, path, verdict``."""
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = cut_lineage(parsed.select("host", "path").distinct())
    rules = cut_lineage(
        rules.where(F.col("host").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))
    )
    depth = rules.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 0
    pieces = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = urls.orderBy(F.xxhash64("host", "path"), "host", "path").limit(SAMPLES * pieces).collect()
    asked = sorted((key, _salt(r["host"], r["path"])) for r in drawn for key in _questions(r["host"], r["path"], depth))
    bounds = [asked[len(asked) * i // pieces] for i in range(1, pieces)] if asked else []

    def questions(batches):
        for batch in batches:
            rows = [
                (bisect_right(bounds, (key, salt)), key, host, path)
                for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                for salt in (_salt(host, path),)
                for key in _questions(host, path, depth)
            ]
            yield _rows(rows, True)

    def openings(batches):
        for batch in batches:
            rows = []
            for host, path, verdict in zip(*[batch.column(c).to_pylist() for c in ("host", "path", "verdict")]):
                key = canonical(host, path)
                first, last = bisect_right(bounds, (key, -1)), bisect_right(bounds, (key + _LAST, 1 << 64))
                rows += [(piece, key, host + path, verdict) for piece in range(first, last + 1)]
            yield _rows(rows, False)

    schema = "piece int, key string, asks boolean, a string, b string"
    both = urls.mapInArrow(questions, schema).unionByName(rules.mapInArrow(openings, schema))
    swept = both.repartition(pieces, "piece").sortWithinPartitions("piece", "key", "asks").mapInArrow(
        _sweep, "host string, path string, size int, host_size int, rule string, verdict string"
    )
    best = swept.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("_best"))
    return parsed.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )


def _rows(rows: list[tuple], asks: bool) -> pa.RecordBatch:
    piece, key, a, b = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(piece, pa.int32()), pa.array(key, pa.string()), pa.array([asks] * len(rows), pa.bool_()),
         pa.array(a, pa.string()), pa.array(b, pa.string())],
        ["piece", "key", "asks", "a", "b"],
    )


def _sweep(batches):
    """Answer the questions of sorted rows from the stack of open rules."""
    current, stack = None, []
    for batch in batches:
        out = []
        for piece, key, asks, a, b in zip(*[batch.column(c).to_pylist() for c in ("piece", "key", "asks", "a", "b")]):
            if piece != current:
                current, stack = piece, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not asks:
                stack.append((key, a, b))
            elif stack:
                opened, rule, verdict = stack[-1]
                out.append((a, b, len(rule), opened.index("/"), rule, verdict))
        columns = zip(*out) if out else ((),) * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = ["host", "path", "size", "host_size", "rule", "verdict"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query(
    "op6_url_filter",
    f"""
    WITH u AS (SELECT page_id,
        coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path, row_number() OVER () AS n FROM pages),
    r(h, p, v) AS (VALUES {_SQL_RULES}),
    f AS (SELECT n, arg_max(h || p, 1000 * length(h || p) + length(h)) AS rule, arg_max(v, 1000 * length(h || p) + length(h)) AS verdict
          FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM u LEFT JOIN f USING (n)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
