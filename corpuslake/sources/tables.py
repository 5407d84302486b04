"""Readers and writers of tables, files and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .parsers import html_blocks, mapped, xml_text


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """A document per JSON file: its text pretty-printed, one page. Text that is no JSON stays as it is."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    pretty = F.expr("to_json(try_parse_json(value), map('pretty', 'true'))")
    return whole.select("path", F.coalesce(pretty, F.col("value")).alias("text"), F.lit(1).alias("pages"))


def read_xml_docs(spark: SparkSession, path: str, tails: bool = False) -> DataFrame:
    """path, text of each XML file: the texts of its elements, a line each (see parsers.xml_text()); the XML itself if it has none, empty if it is not well-formed. Files are read as bytes, as
    their declarations name the encoding; Spark skips files without a byte."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(mapped(["path", "content", "text"], 1, lambda x: xml_text(bytes(x), tails), pa.string()), "path string, content binary, text string")
    return rows.select("path", "text")


def check_cases(rows: DataFrame, order: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Question-bank rows (question, expected_answer, level as text, order): valid ones, and errors with their line numbers (and the columns of keep). Question and answer need
    five characters; a level counts only if it is digits."""
    trimmed = rows.withColumn("question", F.trim("question")).withColumn("expected_answer", F.trim("expected_answer"))
    ok = (F.length("question") >= 5) & (F.length("expected_answer") >= 5)
    ok = F.coalesce(ok, F.lit(False))
    level = F.when(F.col("level").rlike("^\\d+$"), F.col("level").cast("int"))
    return trimmed.where(ok).withColumn("level", level), trimmed.where(~ok).select(*keep, (F.col(order) + 1).alias("line"), F.lit("question and answer need five characters").alias("error"))


def read_cases_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Question banks in CSV with a header (a byte-order mark is skipped): valid rows with path and position, and errors with path and line. A file is read by one
    task, as quoted fields may hold line ends, so its rows are numbered in their order; several files are numbered each."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.select(*(F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in rows.columns), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_i"))
    numbered = rows.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("_i"))).drop("_i")
    return check_cases(numbered, "position", ("path",))


#: The columns of a question bank in JSON, and the older keys that stand for some of them.
CASE_COLUMNS = ["id", "question", "expected_answer", "procedure_group", "intent", "source", "field_type"]
OLDER_KEYS = {"source": "source_doc", "field_type": "field"}


def read_cases_json(spark: SparkSession, path: str) -> DataFrame:
    """Question banks in JSON, an array of cases a file: CASE_COLUMNS and level; keys that a case lacks are null, and older ones count where the newer is missing."""
    schema = ", ".join(f"`{c}` string" for c in [*CASE_COLUMNS, *OLDER_KEYS.values()]) + ", level int"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(*(F.coalesce(c, OLDER_KEYS[c]).alias(c) if c in OLDER_KEYS else F.col(c) for c in CASE_COLUMNS), "level")


def load_cases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming cases whose question is not there yet, each question once (the first by id, where there is one); level 1 where it is missing."""
    if "id" in incoming.columns:
        first = Window.partitionBy("question").orderBy("id")
        incoming = incoming.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return incoming.join(existing.select("question"), "question", "left_anti").withColumn("level", F.coalesce("level", F.lit(1)))


def export_json(df: DataFrame, path: str, order: str) -> None:
    df.orderBy(order).write.mode("overwrite").json(path)


def assemble_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, text, n_pages, n_empty of pages (doc_id, page_no, text): pages with enough characters, joined by blank lines."""
    full = F.length(F.regexp_replace("text", "\\s", "")) >= least
    parts = F.sort_array(F.collect_list(F.when(full, F.struct("page_no", "text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("n_pages"), F.count_if(~full).alias("n_empty"))


def flag_scanned(pages: DataFrame, n: int = 3, least_mean: int = 50) -> DataFrame:
    """doc_id, scanned: whether the first n pages have few characters on average."""
    first = pages.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))).where(F.col("i") <= n)
    return first.groupBy("doc_id").agg((F.avg(F.length(F.trim("text"))) < least_mean).alias("scanned"))


def html_segments(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, level, text: headings, list items and paragraphs of pages.html in order, without scripts, styles, navigation and footers
    (see parsers.html_blocks()). A null page has none."""
    ship(pages.sparkSession)
    block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())])

    def read(page: str) -> list[dict]:
        return [{"kind": k, "level": n, "text": t} for k, n, t in html_blocks(page)]

    rows = pages.select("page_id", "html")
    schema = T.StructType([*rows.schema.fields, T.StructField("s", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])))])
    found = rows.mapInArrow(mapped(["page_id", "html", "s"], 1, read, pa.list_(block)), schema)
    return found.select("page_id", F.posexplode("s").alias("position", "s")).select("page_id", "position", "s.*")


def match_cached_text(files: DataFrame, cache: DataFrame, least: int = 50) -> DataFrame:
    """file, name: the first cached text (by name; longer than least) that shares a number of two to five digits with the file's name, or holds its stem
    in any case. Stems meet the parts of the names that have a stem's length, the first name for each part."""
    numbers = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit("\\d{2,5}"), F.lit(0))))
    have = cache.where(F.length("text") > least).select("name", numbers("name").alias("number")).groupBy("number").agg(F.min("name").alias("name"))
    by_number = files.select("file", numbers("file").alias("number")).join(have, "number").groupBy("file").agg(F.min("name").alias("name"))
    stems = files.select("file", F.lower(F.regexp_replace("file", "(?<=[^/])\\.[^./]*$", "")).alias("stem")).where("stem <> ''").distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("name")))
    sizes = F.broadcast(stems.select(F.length("stem").alias("size")).distinct())
    ends = cache.where((F.length("text") > least) & (F.length("name") > 0)).select("name", starts.alias("start")).join(sizes, F.col("start") + F.col("size") <= F.length("name") + 1)
    held = ends.select("name", F.lower(F.substr("name", F.col("start"), F.col("size"))).alias("stem")).groupBy("stem").agg(F.min("name").alias("name"))
    by_stem = stems.join(held, "stem").select("file", "name")
    return by_number.unionByName(by_stem).groupBy("file").agg(F.min("name").alias("name"))


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, key: str = "chunk_id", by: str = "procedure_type", mode: str = "overwrite") -> None:
    """Chunks with their vectors, partitioned; each chunk must have one vector and each vector a chunk."""
    joined = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full_outer")
    unmatched, repeated = joined.where("_c is null or _v is null").limit(1).count(), joined.groupBy(key).count().where("count > 1").limit(1).count()
    if unmatched or repeated:
        raise ValueError("chunks and vectors do not match one to one")
    joined.drop("_c", "_v").write.partitionBy(by).mode(mode).parquet(path)


def scroll(index: DataFrame, key: str, limit: int = 10_000, **equal) -> DataFrame:
    """The first rows of an index by key, with payload filters."""
    for c, v in equal.items():
        index = index.where(F.col(c) == v)
    return index.orderBy(key).limit(limit)


def rebuild_index(chunks: DataFrame, docs: DataFrame, on: str, source: str, chunk_key: str, text: str) -> DataFrame:
    """Chunks of known documents, numbered within their document, with a word count for the token estimate. The words are counted first, so that no text is
    shuffled or sorted."""
    from ..functions.text import token_estimate

    number = F.row_number().over(Window.partitionBy(source).orderBy(chunk_key)) - 1
    rows = chunks.withColumn("token_estimate", token_estimate(F.col(text), words=True)).drop(*({text} - {on, source, chunk_key}))
    return rows.join(docs, on).select(source, chunk_key, number.alias("chunk_index"), "token_estimate")


def migrate_index(source: DataFrame, vector: str, text: str, defaults: dict) -> DataFrame:
    """Payloads copied with defaults for what is missing; rows with an empty text or a vector of another size than most go."""
    out = source.where(F.length(F.trim(text)) > 0)
    size = out.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size")
    out = out.join(F.broadcast(size), F.size(vector) == F.col("size"), "left_semi")
    return out.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns))


def backfill(index: DataFrame, column: str, value: str) -> DataFrame:
    return index.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == ""), value).otherwise(F.col(column)))
