"""Checks on CV files and stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import strip

PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAX_BYTES = 10 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows of path, length and content."""
    return spark.read.format("binaryFile").load(path)


def sniffed_type(content: Column) -> Column:
    """Media type told by the first bytes."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head.startswith("255044462D"), PDF).when(
        F.substring(head, 1, 8).isin("504B0304", "504B0506", "504B0708"), DOCX
    )


def empty(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def document_error(content: Column, document_id: Column, file_name: Column, declared: Column) -> Column:
    """Error code of a submitted file, null when its text may be extracted."""
    actual = sniffed_type(content)
    return (
        F.when(content.isNull() | empty(document_id) | empty(file_name) | empty(declared), "ENVELOPE_INVALID")
        .when(F.octet_length(content) == 0, "EMPTY_FILE")
        .when(F.octet_length(content) > MAX_BYTES, "FILE_TOO_LARGE")
        .when(~declared.isin(PDF, DOCX), "UNSUPPORTED_MEDIA_TYPE")
        .when(actual.isNotNull() & (actual != declared), "MEDIA_TYPE_MISMATCH")
        .when(actual.isNull() & (declared == PDF), "MALFORMED_PDF")
        .when(actual.isNull(), "MALFORMED_DOCX")
    )


def document_envelope(files: DataFrame) -> DataFrame:
    """Size, hash, types and state of submitted files.

    ``files``: document_id, original_filename, declared_media_type, content.
    """
    error = document_error(
        F.col("content"), F.col("document_id"), F.col("original_filename"), F.col("declared_media_type")
    )
    return files.select(
        "document_id", "original_filename", "declared_media_type",
        sniffed_type(F.col("content")).alias("sniffed_media_type"),
        F.octet_length("content").alias("byte_size"), F.sha2("content", 256).alias("sha256"),
        error.alias("error_code"),
        F.when(error.isNull(), "ENVELOPE_OK").otherwise("CV_EXTRACTION_FAILED").alias("state"),
    )


def document_rules_hold(media_type: Column, sha256: Column, byte_size: Column) -> Column:
    """Rules on a stored document row."""
    return (
        media_type.isin(PDF, DOCX) & sha256.rlike(r"\A[a-f0-9]{64}\z") & byte_size.between(1, MAX_BYTES)
    )


def opaque_path(assessment_id: Column, document_id: Column, media_type: Column) -> Column:
    """Storage path of a document, null for unsafe IDs."""
    safe = r"\A[A-Za-z0-9._-]+\z"
    suffix = F.when(media_type == PDF, "pdf").otherwise("docx")
    return F.when(
        assessment_id.rlike(safe) & document_id.rlike(safe),
        F.format_string("assessments/%s/%s.%s", assessment_id, document_id, suffix),
    )


def canonical_filename(name: Column, media_type: Column) -> Column:
    """File name as given, or the default of the media type."""
    given = F.nullif(strip(name), F.lit(""))
    return F.coalesce(given, F.when(media_type == PDF, "cv.pdf").otherwise("cv.docx"))


def document_differences(declared: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Per document whether the stored row equals the declared one in all fields."""
    names = {f: f"stored_{f}" for f in fields}
    other = stored.select("document_id", F.lit(True).alias("found"), *[F.col(f).alias(n) for f, n in names.items()])
    same = F.col("found").isNotNull()
    for f, n in names.items():
        same = same & F.col(f).eqNullSafe(F.col(n))
    return declared.join(other, "document_id", "left").select(
        "document_id", F.coalesce(same, F.lit(False)).alias("matches")
    )
