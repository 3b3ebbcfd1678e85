"""Delimited text with a declared schema, in and out.

``read_csv`` never infers: it takes the schema, keeps the text of each line that does not fit it, and gives
such lines back as a quarantine with file and text.  ``write_csv`` writes what ``read_csv`` reads back unchanged:
quotes are doubled, nulls (``NULL_TEXT``, which no text should be) and empty strings (two quotes) differ, doubles and
timestamps keep all digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "\\N"
CORRUPT = "_corrupt_line"
_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": NULL_TEXT, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "dateFormat": "yyyy-MM-dd", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantine)``: the lines that fit ``schema``, and ``(file, line)`` of those that do not.

    A line of too few or too many fields or with a value that is not of its type goes to the quarantine whole.  With
    ``multi_line`` values may hold line ends, and a file is then one split."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = (spark.read.schema(wide).options(**_OPTIONS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
             .option("enforceSchema", True).option("multiLine", multi_line).csv(path))
    # a line is judged by the columns that are parsed, so both sides name all of them whatever is selected later
    whole = F.length(F.to_json(F.struct(*[F.col(f"`{n}`") for n in schema.names]))) > 0
    rows = lines.filter(F.col(CORRUPT).isNull() & whole).select(*[F.col(f"`{n}`") for n in schema.names])
    bad = lines.filter(F.col(CORRUPT).isNotNull() & whole)
    return rows, bad.select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> T.StructType:
    """Write ``df`` as text; the returned schema reads it back."""
    df.write.options(**_OPTIONS).mode(mode).csv(path)
    return df.schema
