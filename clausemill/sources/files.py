"""Document folders, tables and reports as sources and sinks.

A folder holds one sub-folder per domain.  Files are read whole through Spark's
``binaryFile`` source, so any store that Spark reads will do.
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.text import clean_extracted, strip, strip_scraped, word_count

#: Schemas of the tables between stages.
SCHEMAS = {
    "manifest": "domain string, filename string, source_path string, output_path string, word_count int, char_count int, status string",
    "clauses": "clause_id string, source_doc string, domain string, raw_text string, word_count int, pattern_label string",
    "labeled": "clause_id string, source_doc string, domain string, raw_text string, word_count int, pattern_label string, clean_text string, token_count int, risk_score double, risk_label string",
    "category_descriptions": "category string, description string, answer_format string, answer_group string",
}


def decode_lossy(content: Column) -> Column:
    """UTF-8 without the bytes that do not fit; a U+FFFD of the text itself stays (meanwhile as U+10FFFF, which no text has)."""
    marked = F.replace(F.decode(content, "ISO-8859-1"), F.lit(b"\xef\xbf\xbd".decode("latin-1")), F.lit(b"\xf4\x8f\xbf\xbf".decode("latin-1")))
    valid = F.make_valid_utf8(F.encode(marked, "ISO-8859-1").cast("string"))
    return F.replace(F.replace(valid, F.lit("\ufffd"), F.lit("")), F.lit("\U0010ffff"), F.lit("\ufffd"))


def decode_fallback(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("txt", "text", "pdf")) -> DataFrame:
    """source_path, domain (the folder), filename, extension, content of the files under root."""
    files = _packed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    path = F.col("path")
    rows = files.select(path.alias("source_path"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("domain"), F.regexp_extract(path, "([^/]+)$", 1).alias("filename"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"), "content")
    return rows.where(F.col("extension").isin(*extensions))


def _packed(files: DataFrame, splits: int = 16) -> DataFrame:
    """Spark counts opening a file as 4 MB, so small files are some 30 to a task; up to ``splits`` such tasks become one, where all cores have a few left."""
    parts = files.rdd.getNumPartitions()
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-parts // splits))
    return files.coalesce(tasks) if tasks < parts else files


def pdf_library() -> str | None:
    """The library that reads PDF files, where one is installed."""
    return "pdfplumber" if importlib.util.find_spec("pdfplumber") else None


def pdf_text(rows: DataFrame, after: str = "", between: str = "\n") -> DataFrame:
    """Adds ``text`` from PDF content: pages with ``between`` between and ``after`` after each; empty where a file cannot be read.

    Without a PDF library text is null, and a manifest says so (``no_pdf_library``).
    """
    if not pdf_library():
        return rows.withColumn("text", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def pages(content: pd.Series) -> pd.Series:
        import io

        import pdfplumber

        def one(data: bytes) -> str:
            try:
                with pdfplumber.open(io.BytesIO(data)) as f:
                    return between.join((p.extract_text() or "") + after for p in f.pages)
            except Exception:  # noqa: BLE001  a broken file is an empty document
                return ""

        return content.map(one)

    return rows.withColumn("text", pages("content"))


def online_pdf(rows: DataFrame) -> DataFrame:
    """doc (the path), text of PDF files as the online analysis reads them: two line feeds after each page, no cleaning."""
    return pdf_text(rows, "\n\n", "").select(F.col("source_path").alias("doc"), "text")


def extract(rows: DataFrame) -> DataFrame:
    """Adds ``text``: cleaned text of every scanned file, by its extension."""
    pdf = F.col("extension") == "pdf"
    # one pass: a union of the two kinds would open every file twice
    read = pdf_text(rows.withColumn("_whole", F.col("content")).withColumn("content", F.when(pdf, F.col("content")))).withColumn("content", F.col("_whole")).drop("_whole")
    read = read.withColumn("text", F.when(pdf, F.col("text")).otherwise(decode_fallback(F.col("content"))))
    return read.withColumn("text", F.when(F.col("extension").isin("txt", "text", "pdf"), clean_extracted(F.col("text"))).otherwise(F.lit("")))


def manifest(extracted: DataFrame, output_root: str, min_words: int = 50) -> DataFrame:
    """One row per file, kept or skipped."""
    base = F.regexp_replace("filename", r"\.[^.]*$", "")
    words = word_count(F.col("text"))
    status = F.when(F.col("text").isNull(), "no_pdf_library").when(words >= min_words, "ok").otherwise("skipped_too_short")
    return extracted.select("domain", "filename", "source_path", F.concat(F.lit(output_root.rstrip("/") + "/"), "domain", F.lit("/"), base, F.lit(".txt")).alias("output_path"), words.alias("word_count"), F.length("text").alias("char_count"), status.alias("status"))


def documents(extracted: DataFrame, min_words: int = 50) -> DataFrame:
    """domain, source_doc, text of the files with enough words."""
    # of an outer explode the text is computed once, not once more for a filter below it
    rows = extracted.select("domain", F.regexp_replace("filename", r"\.[^.]*$", "").alias("source_doc"), F.explode_outer(F.array("text")).alias("text"))
    return rows.where(word_count(F.col("text")) >= min_words)


def write_documents(docs: DataFrame, root: str) -> None:
    """Texts under one folder per domain; each document is one row, kept whole."""
    docs.select("domain", "source_doc", "text").write.mode("overwrite").partitionBy("domain").parquet(root)


def write_text_files(docs: DataFrame, root: str) -> None:
    """Plain text under one folder per domain and document."""
    docs.select(F.col("text").alias("value"), "domain", "source_doc").write.mode("overwrite").partitionBy("domain", "source_doc").text(root)


def remote_records(rows: DataFrame, text: str, order: str, most: int = 40, min_words: int = 30) -> DataFrame:
    """The first ``most`` staged texts of enough words, named by their place in the source."""
    kept = rows.where(word_count(F.col(text)) >= min_words).orderBy(order).limit(most)
    return kept.select(F.lit("legal").alias("domain"), F.format_string("ledgar_%04d", F.col(order).cast("int")).alias("source_doc"), F.col(text).alias("text"))


def scraped(pages: DataFrame, html: str, min_words: int = 150) -> DataFrame:
    """Text of staged pages with more than so many words; fetching is left to the ingest."""
    return pages.withColumn("text", strip_scraped(F.col(html))).where(word_count(F.col("text")) > min_words)


def literal_documents(spark: SparkSession, texts: dict[tuple[str, str], str]) -> DataFrame:
    """Documents given in code, by (domain, name)."""
    return spark.createDataFrame([(d, n, strip_margin(t)) for (d, n), t in texts.items()], "domain string, source_doc string, text string")


def strip_margin(text: str) -> str:
    return text.strip()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; the schema is given, never inferred."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_report(reports: dict[str, DataFrame], path: str) -> None:
    """Each report as a table under its name."""
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def usable(docs: DataFrame, min_chars: int = 50) -> DataFrame:
    """Documents whose stripped text has enough characters."""
    return docs.where(F.length(strip(F.coalesce("text", F.lit("")))) >= min_chars)
