"""Readers of stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gleanery import constants as K

PAGE_SCHEMA = (
    "url string, title string, content string, page_type string, structured struct<email:string,rank:string,office:string,"
    "phone:string,research_areas:array<string>,personal_websites:array<string>,courses:array<struct<code:string,"
    "title:string,credits:string,description:string,prereqs:array<string>>>>, content_hash string, word_count int, "
    "depth int, source string, crawled_at string, last_modified string, pdf_links array<string>, pdf_paths array<string>, "
    "heading_path array<string>, outgoing_links array<string>, courses_mentioned array<string>, faculty_names array<string>")


def read_jsonl(spark: SparkSession, path: str, schema: str | T_.StructType) -> DataFrame:
    """One record per line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | T_.StructType) -> DataFrame:
    """One record per line; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T_.StructType | None = None) -> DataFrame:
    """A whole JSON document (object or array of objects) per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def latest_crawl(spark: SparkSession, folder: str, pattern: str = "crawl_*.jsonl") -> str | None:
    """Path of the lexicographically last crawl file; only the listing is read, not the files."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return listing.agg(F.max("path").alias("p")).first()["p"]


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)


def existing_paths(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of (path, …) whose file exists in a listing of (path)."""
    plain = F.regexp_replace("path", "^file:/+", "/")
    return listed.join(files.select(plain.alias("path")).distinct(), "path", "left_semi")


def seed_urls(spark: SparkSession) -> DataFrame:
    """Start pages of a crawl with their source."""
    return spark.createDataFrame(list(K.SEED_URLS), "url string, source string")
