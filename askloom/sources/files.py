"""Reading a corpus folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as T

#: Text and Markdown in any letter case.
TEXT_GLOB = "*.{[tT][xX][tT],[mM][dD]}"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
SCHEME = re.compile("^[a-z0-9]+:(//[^/]*)?")
EXTENSION = r"^.+(\.[^.]+)$"


def with_path_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Relative path to name, stem, extension, topic (first folder) and subtopic (second)."""
    parts = F.split(path, "/", -1)
    name = F.element_at(parts, -1)
    extension = F.regexp_extract(name, EXTENSION, 1)
    return df.withColumns(
        {
            "source_rel": F.col(path),
            "source_name": name,
            "source_stem": F.substring(name, F.lit(1), F.length(name) - F.length(extension)),
            "source_ext": F.lower(extension),
            "topic": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("General"),
            "subtopic": F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(""),
        }
    )


def drop_blank(docs: DataFrame) -> DataFrame:
    """Strip texts and drop the blank ones."""
    return T.keep_non_blank(docs, T.strip(F.col("text")))


def decode_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text; bad bytes vanish instead of becoming replacement marks.

    A replacement mark that the file itself holds vanishes too.
    """
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit(chr(0xFFFD)), F.lit(""))


def plain_path(uri: Column) -> Column:
    """A path without scheme and escapes: the same for batch and stream."""
    unescaped = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(unescaped, SCHEME.pattern, "")


def as_documents(files: DataFrame, folder: str) -> DataFrame:
    """(source, text, version) and path metadata of binary file rows; blank ones drop."""
    base = SCHEME.sub("", folder).rstrip("/")
    docs = files.select(
        plain_path(F.col("path")).alias("source"),
        decode_utf8(F.col("content")).alias("text"),
        F.col("modificationTime").alias("version"),
    )
    relative = F.substring("source", F.lit(len(base) + 2), F.length("source"))
    return drop_blank(with_path_metadata(docs.withColumn("rel", relative), "rel").drop("rel"))


def load_text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Text and Markdown files under ``folder`` (absolute), with path metadata; blank ones drop.

    Files that cannot be read are skipped. PDF and DOCX texts come in as page
    tables (``operators.corpus.assemble_pages``); legacy .doc is not read.
    """
    read = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", TEXT_GLOB)
        .option("ignoreCorruptFiles", True)
        .load(folder)
    )
    return as_documents(read, folder).drop("version")
