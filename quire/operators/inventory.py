"""The audit of a corpus of files: classes, duplicates, summary, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEGACY = (".doc", ".wps")
ATTACHMENTS = (".png", ".jpg", ".jpeg", ".gif", ".xls", ".xlsx", ".zip", ".rar", ".7z", ".ppt", ".pptx", ".txt", ".csv")
LAYOUT_RISKS = ("SOURCE_LANDSCAPE_SECTION_UNSUPPORTED", "COMPLEX_TABLE_UNSUPPORTED", "TABLE_MERGE_UNSUPPORTED")


def _as(name: str, confidence: float, reason: str) -> Column:
    return F.struct(F.lit(name).alias("classification"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def classify_docx() -> Column:
    """By paragraphs, tables, headers (and footers), fields, toc_fields, text_chars and risk; the first rule counts."""
    c = F.col
    return (
        F.when((c("toc_fields") > 0) | ((c("headers") > 0) & (c("fields") > 0)), _as("reference_candidate", 0.78, "docx_has_toc_or_layout_fields"))
        .when((c("text_chars") < 3000) & ((c("tables") >= 2) | (c("headers") > 0) | (c("fields") > 0)), _as("template_candidate", 0.72, "short_docx_with_format_structures"))
        .when((c("paragraphs") >= 120) | (c("text_chars") >= 12000), _as("content_candidate", 0.76, "long_body_like_docx"))
        .when(c("risk").isin(*LAYOUT_RISKS), _as("reference_candidate", 0.62, "docx_has_layout_risk_reference_value"))
        .otherwise(_as("content_candidate", 0.58, "ordinary_docx_body_candidate"))
    )


def classify_pdf() -> Column:
    per_page = F.col("text_chars") / F.greatest(F.col("pages"), F.lit(1))
    return (
        F.when((F.col("pages") > 0) & (per_page < 20), _as("unsupported_or_conversion_needed", 0.9, "scanned_or_textless_pdf"))
        .when((F.col("pages") <= 8) & (per_page > 40), _as("template_candidate", 0.65, "short_text_pdf_likely_template_or_rules"))
        .when(F.col("pages") >= 9, _as("reference_candidate", 0.68, "multi_page_pdf_likely_reference_sample"))
        .otherwise(_as("template_candidate", 0.48, "pdf_requires_human_review"))
    )


def classify(files: DataFrame) -> DataFrame:
    """files with classification, confidence and reason by extension and features."""
    ext = F.lower("ext")
    made = (
        F.when(ext.isin(*LEGACY), _as("unsupported_or_conversion_needed", 0.95, "legacy_format"))
        .when(ext.isin(*ATTACHMENTS), _as("attachment_or_nonpaper", 0.9, "attachment_or_nonpaper_ext"))
        .when(ext == ".docx", classify_docx()).when(ext == ".pdf", classify_pdf())
        .otherwise(_as("attachment_or_nonpaper", 0.65, "unrecognized_ext"))
    )
    return files.withColumn("__c", made).select(*files.columns, "__c.*")


def mark_duplicates(files: DataFrame) -> DataFrame:
    """files(scan_ord, path, digest, ...) with duplicate_of: the path of the first file of equal digest, for later ones.

    The first of each digest is a partial aggregate, joined back, so a digest of a third of all files is no hot group of
    a window. An empty digest never matches.
    """
    first = files.where("digest <> ''").groupBy("digest").agg(F.min(F.struct("scan_ord", "path")).alias("__f"))
    joined = files.join(first, "digest", "left")
    return joined.withColumn("duplicate_of", F.when(F.col("__f.scan_ord") < F.col("scan_ord"), F.col("__f.path"))).drop("__f")


def summary(files: DataFrame) -> DataFrame:
    """Counts by classification, by extension, by risk code, and in all; one pass with grouping sets."""
    ext = F.when(F.col("ext") == "", "<no_ext>").otherwise(F.col("ext"))
    t = files.select("classification", ext.alias("extension"), F.nullif(F.col("risk"), F.lit("")).alias("risk"))
    g = t.groupingSets([[F.col("classification")], [F.col("extension")], [F.col("risk")], []], "classification", "extension", "risk").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "classification").when(F.col("g") == 5, "extension").when(F.col("g") == 6, "risk").otherwise("total")
    key = F.coalesce("classification", "extension", "risk", F.lit(""))
    return g.select(kind.alias("kind"), key.alias("key"), "n").where("NOT (kind = 'risk' AND key = '')")


def review_queue(files: DataFrame) -> DataFrame:
    """What a person should look at: low confidence, unsupported, or with a risk; in order."""
    need = (F.col("confidence") < 0.7) | (F.col("classification") == "unsupported_or_conversion_needed") | (F.col("risk") != "")
    return files.where(need).select("path", "classification", "confidence", "reason", "risk").orderBy("classification", "confidence", "path")
