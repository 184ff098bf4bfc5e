"""Order-preserving readers: JSON lines, JSON arrays, tab-separated tables, score files.

Every reader adds ``file`` and ``ordinal`` (line number within the file), the
order that positions mean in these formats. Files are listed by Spark in path
order. Text stays text: rows keep their JSON, so key order and number types are
not lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from toolweave.sources.splits import cut_records, json_pieces, quoted_pieces

ROW_COLUMNS = "file string, ordinal bigint, value string"


def read_lines(spark: SparkSession, paths: str | list[str], tolerant: bool = True) -> DataFrame:
    """(file, ordinal, value) of each line; blank lines are skipped, unless ``tolerant`` is false.

    Large files are read in splits by many tasks. A line's ordinal is its place in
    its split, which one task reads in order, after the lines of the splits before.
    """
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = read.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # one row per split, as many as there are tasks
    rows = read.join(F.broadcast(splits), ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("ordinal"), "value")
    return rows.filter(F.trim("value") != "") if tolerant else rows


def read_json_lines(spark: SparkSession, paths: str | list[str], fields: dict[str, str], tolerant: bool = True) -> DataFrame:
    """``read_lines`` with the top-level ``fields`` (name to Spark type; ``json`` for the raw text) and ``is_json``.

    ``tolerant`` keeps, per file, the rows before the first unreadable one, as a
    reader that stops there would; otherwise all rows stay, marked.
    """
    rows = read_lines(spark, paths, tolerant).withColumn("is_json", F.try_parse_json("value").isNotNull())
    if tolerant:
        bad = rows.filter(~F.col("is_json")).groupBy("file").agg(F.min("ordinal").alias("bad"))
        rows = rows.join(bad, "file", "left").filter("bad is null or ordinal < bad").drop("bad")
    for name, kind in fields.items():
        text = F.get_json_object("value", f"$['{name}']")
        rows = rows.withColumn(name, text if kind in ("json", "string") else F.from_json(text, kind) if kind.startswith(("array", "struct", "map")) else text.cast(kind))
    return rows


def read_existing_json_lines(spark: SparkSession, paths: list[str], fields: dict[str, str]) -> DataFrame:
    """As ``read_json_lines``; paths that match no file are left out, and none at all give an empty table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            there.append(p)
    if there:
        return read_json_lines(spark, there, fields)
    out = spark.createDataFrame([], f"{ROW_COLUMNS}, is_json boolean")
    for name, kind in fields.items():
        out = out.withColumn(name, F.lit(None).cast("string" if kind == "json" else kind))
    return out


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that are one JSON array each, with their ordinal in it; a file of one line is read by many tasks.

    An element that is no object is a row of nulls; a file that is one object is one row.
    """
    rows = cut_records(json_pieces(spark, path), ",", arrays=True)
    text = F.when(F.col("record") == 0, F.regexp_replace("value", r"^[\s\x{FEFF}]*\[", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", text).withColumn("value", F.when(F.col("last"), F.regexp_replace("value", r"\]\s*$", "")).otherwise(F.col("value")))
    rows = rows.filter(~((F.col("record") == 0) & F.col("last") & (F.trim("value") == "")))
    return rows.select("file", F.col("record").alias("ordinal"), F.from_json("value", f"struct<{schema}>").alias("row")).select("file", "ordinal", "row.*")


def _quoted_rows(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    """(file, record, columns of ``schema``) of tab-separated files with quoting, line feeds in fields included, read in splits."""
    rows = cut_records(quoted_pieces(spark, path), "\n", arrays=False).withColumn("value", F.regexp_replace("value", r"\r$", ""))
    rows = rows.filter((F.col("value") != "") & (F.col("record") > 0 if header else F.lit(True)))
    return rows.select("file", "record", F.from_csv("value", schema, {"sep": "\t", "quote": '"', "escape": '"'}).alias("row")).select("file", "record", "row.*")


def read_corpus(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """(docid, document_content) from a tab-separated table with header and quoting."""
    rows = _quoted_rows(spark, path, "docid int, document_content string", header=True)
    if not last_wins:
        return rows.select("docid", "document_content")
    return rows.groupBy("docid").agg(F.max_by("document_content", F.struct("file", "record")).alias("document_content"))


def read_queries(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """(qid, query) from a tab-separated table without header; ``quoted`` reads what the writer quotes."""
    if quoted:
        return _quoted_rows(spark, path, "qid int, query string", header=False).select("qid", "query")
    return spark.read.csv(path, sep="\t", quote="", escape='"', schema="qid int, query string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (qid, docid, label) from a tab-separated table without header."""
    rows = spark.read.csv(path, sep="\t", schema="qid int, head int, docid int, label int")
    return rows.select("qid", "docid", "label").dropDuplicates(["qid", "docid"])


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """(model, category, accuracy, process_accuracy, total_count) from the first line of each ``<model>/data_<category>_score.json``.

    A score file may be a folder of part files, as Spark writes them.
    """
    rows = read_lines(spark, f"{root}/*/data_*_score.json").filter("ordinal = 0")
    rows = rows.withColumn("name", F.regexp_extract("file", r"([^/]+/data_[^/]+_score\.json)(?:/[^/]*)?$", 1)).filter(~F.col("name").contains("process"))
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return rows.select(F.regexp_extract("name", r"([^/]+)/", 1).alias("model"), F.regexp_extract("name", r"data_(.+)_score\.json$", 1).alias("category"), field("accuracy", "double"), field("process_accuracy", "double"), field("total_count", "long"))


def subsets(spark: SparkSession, root: str, phase: str = "test") -> DataFrame:
    """(subset, qid, query) over all ``<root>/*/*/<phase>.query.txt``, files or folders of part files: all subsets in one table."""
    rows = read_lines(spark, f"{root}/*/*/{phase}.query.txt")
    cells = F.split("value", "\t", 2)
    return rows.select(F.regexp_extract("file", rf"([^/]+/[^/]+)/{phase}\.query\.txt(?:/[^/]*)?$", 1).alias("subset"), cells[0].cast("int").alias("qid"), F.regexp_replace(cells[1], r'^"|"$', "").alias("query"))


def find_files(spark: SparkSession, folder: str, part: str) -> list[str]:
    """Paths of a folder's files whose name holds ``part``, by name; those of multi-turn cases only if ``part`` asks for them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(path))
    return [f"{folder.rstrip('/')}/{n}" for n in names if part in n and ("multi_turn" in part or "multi_turn" not in n)]


def batches(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows in lists of ``size`` for a consumer outside Spark; one partition at a time is in memory."""
    part: list[Row] = []
    for row in rows.toLocalIterator():
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
