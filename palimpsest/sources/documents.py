"""A folder of prose documents: one message per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import chunk_paragraphs, prose
from palimpsest.sources.files import relative_path
from palimpsest.sources.registry import register_source

MAX_CHUNK_WORDS = 1500
MAX_FILE_BYTES = 5 * 1024 * 1024
SKIP_DIRS = ["node_modules", ".venv", "venv", "site-packages", "__pycache__"]


def document_messages(docs: DataFrame, root: str, max_words: int = MAX_CHUNK_WORDS) -> DataFrame:
    """Canonical messages of documents (rel, text, ts): prose in chunks, one conversation per folder."""
    folder = F.regexp_extract("rel", r"(?s)^(.*)/[^/]*$", 1)
    base = root.rstrip("/")
    chunks = docs.select(
        "rel", "ts", F.posexplode_outer(chunk_paragraphs(prose(F.col("text")), max_words)).alias("i", "text")
    ).filter("text is not null")
    return chunks.select(
        F.when(folder == "", F.lit(base))
        .otherwise(F.concat(F.lit(base + "/"), folder))
        .alias("conversation_external_id"),
        "text",
        "ts",
        F.lit(True).alias("is_me"),
        F.lit("doc").alias("register"),
        F.concat_ws("#", "rel", F.col("i").cast("string")).alias("external_id"),
        F.when(folder == "", F.lit(base.rsplit("/", 1)[-1])).otherwise(folder).alias("conversation_title"),
        F.lit(False).alias("is_group"),
        F.lit(None).cast("string").alias("sender_handle"),
        F.lit(None).cast("string").alias("sender_name"),
        F.create_map(F.lit("file"), F.col("rel"), F.lit("chunk"), F.col("i").cast("string")).alias("meta"),
        F.col("i").cast("long").alias("seq"),
    )


@register_source("documents", kind="doc", register="doc", label="documents")
def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """md / txt / markdown files up to 5 MiB outside hidden and dependency folders."""
    rel = F.try_url_decode(F.replace(relative_path(F.col("path"), path), F.lit("+"), F.lit("%2B")))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumn("rel", rel)
        .filter(F.col("rel").rlike(r"(?i)\.(?:md|txt|markdown)$") & (F.col("length") <= MAX_FILE_BYTES))
        .filter(
            ~F.exists(F.split("rel", "/"), lambda p: p.startswith(".") | p.isin(SKIP_DIRS))
        )
    )
    docs = files.select(
        "rel",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("modificationTime").alias("ts"),
    )
    return document_messages(docs, path)
