"""Uploaded files: reading, recognising, admitting and de-duplicating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import identity, text

# File signatures.
SIGNATURES = {"pdf": "255044462D", "docx": "504B0304"}


def read_corpus(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder as (path, filename, size_bytes, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        "content",
    )


def _starts(content: Column, signature: str) -> Column:
    head = F.substring(content, 1, len(signature) // 2)
    return head == F.unhex(F.lit(signature))


def signature_format(content: Column) -> Column:
    return F.coalesce(*[
        F.when(_starts(content, signature), name) for name, signature in SIGNATURES.items()
    ])


def valid_text(content: Column) -> Column:
    """Whole content is UTF-8 without NUL bytes."""
    as_text = content.cast("string")
    return F.is_valid_utf8(as_text) & ~F.contains(as_text, F.lit("\x00"))


def sniff_format(files: DataFrame) -> DataFrame:
    """Add ``suffix`` and ``format``; null where suffix and content do not agree."""
    suffix, content = F.col("suffix"), F.col("content")
    resolved = (
        F.when(suffix == "", signature_format(content))
        .when((suffix == "md") & valid_text(content), "md")
        .when(suffix.isin(*SIGNATURES) & (signature_format(content) == suffix), suffix)
    )
    return files.withColumn("suffix", text.file_suffix(F.col("filename"))).withColumn(
        "format", resolved
    )


def content_id(files: DataFrame) -> DataFrame:
    return files.withColumn("id", identity.sha256(F.col("content")))


def dedup_documents(files: DataFrame, order: Column) -> DataFrame:
    """One row per content, the first by ``order``. Content itself is not shuffled twice:
    the aggregate keeps one row per id and task before the exchange."""
    from textloom.functions.ordered import earliest

    return earliest(files, ["id"], [order])


def format_conflicts(files: DataFrame) -> DataFrame:
    """Contents uploaded under more than one format."""
    return (
        files.groupBy("id")
        .agg(F.min("format").alias("_lo"), F.max("format").alias("_hi"),
             F.count(F.lit(1)).alias("uploads"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("id", "uploads")
    )


def upload_reason(size: Column, suffix: Column, fmt: Column) -> Column:
    """First reason to reject a file before its text is looked at, null to go on."""
    return (
        F.when(size > schemas.MAX_UPLOAD_BYTES, "size_limit")
        .when(~suffix.isin(*schemas.FORMATS), "unsupported_format")
        .when(fmt.isNull(), "corrupt_file")
    )


def text_reason(fmt: Column, pages: Column, letters: Column, text_bytes: Column,
                blocks: Column) -> Column:
    """First reason to reject a document by its extracted text, null to accept it."""
    return (
        F.when((fmt == "pdf") & (letters < 1), "scanned_pdf")
        .when(pages > schemas.MAX_PAGES, "page_limit")
        .when(text_bytes > schemas.MAX_TEXT_BYTES, "text_limit")
        .when(blocks < 1, "corrupt_file")
    )


def admit(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Files with ``error_code``: null is accepted. Filter on it for the two sides.

    ``files``: id, size_bytes, suffix, format, page_count. ``blocks``: document_id,
    source_text.
    """
    sizes = blocks.groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("block_count"),
        F.sum(F.octet_length("source_text")).alias("text_bytes"),
        F.sum(F.length(F.regexp_replace("source_text", text.SPACE_CLASS + "+", "")))
        .alias("letters"),
    )
    measured = files.join(sizes, "id", "left").fillna(
        0, ["block_count", "text_bytes", "letters"]
    )
    reason = F.coalesce(
        upload_reason(F.col("size_bytes"), F.col("suffix"), F.col("format")),
        text_reason(F.col("format"), F.col("page_count"), F.col("letters"),
                    F.col("text_bytes"), F.col("block_count")),
    )
    return measured.withColumn("error_code", reason)


def aligned_lines(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, position, text) for every line of parallel text."""
    lines = F.posexplode(text.lines(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), lines.alias("position", "_line")).select(
        "id", "position", F.col("_line.content").alias(name)
    )


def read_pairs(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Line n of one text beside line n of the other; both frames have id and text."""
    left = aligned_lines(source, "id", "text", "source")
    right = aligned_lines(reference, "id", "text", "reference")
    return left.join(right, ["id", "position"])


def read_text_pair(spark: SparkSession, source: str, reference: str) -> DataFrame:
    """Two aligned text files."""
    def whole(path: str) -> DataFrame:
        return spark.read.format("binaryFile").load(path).select(
            F.lit(0).alias("id"), F.col("content").cast("string").alias("text")
        )

    return read_pairs(whole(source), whole(reference)).drop("id")
