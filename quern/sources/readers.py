"""Readers: files in several formats, discovery, incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_FORMATS = ("parquet", "json", "csv", "text", "orc", "binaryFile")


def discover(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, low: int = 0, high: int | None = None) -> DataFrame:
    """(path, size, modified) of files, by Spark's own listing; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("size") >= low)
    return out.where(F.col("size") <= high) if high is not None else out


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text, hash): one row per file."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with text."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that do not parse keep their text in _corrupt_record; _path names the file."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_path"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json("value", full, options).alias("r"), "_path").select("r.*", "_path")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By suffix: JSON lines, JSON array or CSV; other suffixes give no rows."""
    for suffix, reader in ((".jsonl", read_json_lines), (".json", read_json_array), (".csv", read_csv)):
        if path.endswith(suffix):
            return reader(spark, path, schema)
    return spark.createDataFrame([], schema)


def normalize_documents(df: DataFrame, ids=("id", "doc_id", "_id"), texts=("text", "content", "body"), title: str = "title") -> DataFrame:
    """(id, text): the first alias present, with the title and an empty line before the text."""
    have = set(df.columns)
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    head = F.when(F.length(F.col(title)) > 0, F.concat(F.col(title), F.lit("\n\n"))).otherwise("") if title in have else F.lit("")
    return df.select(pick(ids).alias("id"), F.concat(F.coalesce(head, F.lit("")), pick(texts)).alias("text"))


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose hash is new and whose path was not processed at their time or later.
    files: (path, hash, modified), done: the same."""
    fresh = files.join(done.select("hash"), "hash", "left_anti")
    seen = done.groupBy("path").agg(F.max("modified").alias("seen"))
    return fresh.join(seen, "path", "left").where(F.col("seen").isNull() | (F.col("seen") < F.col("modified"))).select(*files.columns)


def first_per_hash(files: DataFrame) -> DataFrame:
    return files.groupBy("hash").agg(F.min("path").alias("path"))


def load_status(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """(path, n, failed, status) per file of JSON lines."""
    out = df.select(F.col("_path").alias("path"), F.col(corrupt).isNotNull().alias("bad")).groupBy("path").agg(F.count("*").alias("n"), F.count_if("bad").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == F.col("n"), "FAILED").otherwise("SUCCESS"))


def load_files(spark: SparkSession, folder: str, pattern: str, loader, validator=None, attempts: int = 3, wait: float = 0.0, skip: bool = True) -> DataFrame:
    """(path, status, attempts, error, loaded): each file given to loader(bytes) within a task, anew if it raises, so many times.

    status is SUCCESS, FAILED (the last attempt raised) or SKIPPED (the
    validator said no to what was loaded); loaded is its JSON text. With skip
    off a failed file fails the job. A file must fit into a task.
    """
    import json
    import time

    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                for n in range(1, attempts + 1):
                    try:
                        value = loader(raw)
                        break
                    except Exception as error:  # whatever a loader raises is its file's result
                        problem = f"{type(error).__name__}: {error}"
                        if n < attempts:
                            time.sleep(wait * 2 ** (n - 1))
                else:
                    if not skip:
                        raise RuntimeError(f"{path}: {problem}")
                    rows.append((path, "FAILED", n, problem, None))
                    continue
                good = validator is None or validator(value)
                rows.append((path, "SUCCESS" if good else "SKIPPED", n, None, json.dumps(value) if good else None))
            yield pd.DataFrame(rows, columns=["path", "status", "attempts", "error", "loaded"])

    return files.mapInPandas(run, "path string, status string, attempts int, error string, loaded string")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """One row per element of that tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, common entities are resolved, spaces are single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): paragraphs of word-processor files; files that do not open give null."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder)

    def extract(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            texts = []
            for raw in pdf["content"]:
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
                    texts.append("\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p")))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    texts.append(None)
            yield pdf[["path"]].assign(text=texts)

    return df.select("path", "content").mapInPandas(extract, "path string, text string")
