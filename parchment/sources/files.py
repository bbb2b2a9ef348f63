"""Files as rows: discovery, routing and text decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File kinds that have a parser, and how sure their route is.
ROUTES = {"pdf": 0.9, "docx": 0.95, "txt": 0.98, "doc": 0.75, "hwp": 0.82}
UNKNOWN = 0.1
SKIPPED = "readme.md"
#: Encodings tried in this order for what isn't UTF-8; the last one reads anything.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/", -1), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def route(path: Column) -> Column:
    """(document_type, parser_route, confidence, recommended_action) by file extension."""
    ext = extension(path)
    known = ext.isin(*ROUTES)
    sure = F.lit(UNKNOWN)
    for kind, confidence in ROUTES.items():
        sure = F.when(ext == kind, confidence).otherwise(sure)
    return F.struct(
        F.when(known, ext).otherwise("unsupported").alias("document_type"),
        F.when(known, ext).otherwise("conversion_fallback").alias("parser_route"),
        sure.cast("double").alias("confidence"),
        F.when(known, "parse").otherwise("convert").alias("recommended_action"),
    )


def discover(spark: SparkSession, root: str, streaming: bool = False) -> DataFrame:
    """Files below a root that have a parser, with their bytes; as a stream if asked for."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read
    kinds = "{" + ",".join(f"*.{x}" for k in ROUTES for x in (k, k.upper())) + "}"
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", kinds).load(root)
    name = F.element_at(F.split("path", "/", -1), -1)
    return files.where(F.lower(name) != SKIPPED).withColumn("route", route(F.col("path")))


def decode_texts(files: DataFrame) -> DataFrame:
    """(path, text, encoding) of text files.

    UTF-8 is decoded in the JVM; only the rest goes through Python, with the other encodings.
    """
    @F.pandas_udf("struct<text:string,encoding:string>")
    def other(contents: pd.Series) -> pd.DataFrame:
        def read(raw: bytes) -> tuple[str, str]:
            for encoding in ENCODINGS[2:]:
                try:
                    return raw.decode(encoding), encoding
                except UnicodeDecodeError:
                    continue
            raise AssertionError("the last encoding reads anything")

        return pd.DataFrame([read(x) for x in contents], columns=["text", "encoding"])

    marked = F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    good = files.where(valid).select("path", body.alias("text"), F.when(marked, "utf-8-sig").otherwise("utf-8").alias("encoding"))
    bad = files.where(~valid).withColumn("found", other("content")).select("path", "found.text", "found.encoding")
    return good.unionByName(bad)
