"""CSV sample reader and table export.

``read_csv_sample`` mirrors the reference's reader (header, null token
"(NULL)", bad lines skipped) with an explicit schema: a row with more fields
than the schema is dropped, a short row is padded with nulls (what pandas does
with error_bad_lines=False).  Spark's DROPMALFORMED would also drop short rows,
so we read in PERMISSIVE mode with the raw text of rows of another length, and drop those
whose text has more separators than the schema (outside quotes).  Windows code-page names such as 'ANSI' are not charsets:
pass the real one (default UTF-8).

Quotes follow the usual rule on both sides: a field with the separator, a
quote or a line break stands in double quotes, quotes in it are doubled, and
blanks at its ends stay.  Quoted line breaks need ``multi_line`` (the default),
which reads each file as a whole; a folder of many part files is still read in
parallel.  Pass ``multi_line=False`` for large single files known to have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "__raw"  # raw text of a row whose number of fields differs from the schema's


def read_csv_sample(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8",
                    null_value: str = "(NULL)", header: bool = True, multi_line: bool = True) -> DataFrame:
    """The rows of a CSV file or folder.  A value that its column's type can't hold is an error
    (raised by the query that reads it), never a silent null."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = RAW
    while raw in schema.names:
        raw += "_"
    full = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(raw, T.StringType())])
    df = (spark.read.schema(full).option("header", header).option("nullValue", null_value)
          .option("encoding", encoding).option("mode", "PERMISSIVE").option("multiLine", multi_line)
          .option("columnNameOfCorruptRecord", raw).option("columnPruning", False)
          .options(**QUOTING).csv(path))
    bare = F.regexp_replace(F.col(raw), r'"(?:[^"]|"")*"', "")
    too_long = F.length(bare) - F.length(F.replace(bare, F.lit(","))) >= len(schema.fields)
    # a query may not read the raw text alone, so the first field is always looked at
    first = F.coalesce(F.length(schema.names[0]) >= 0, F.lit(True))
    return df.where((F.col(raw).isNull() | ~too_long) & first).select(*[_typed(f) for f in schema.fields])


#: Quotes are doubled inside quotes, and blanks belong to the field.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _typed(f: T.StructField):
    """The text column as the wanted type; text that isn't one raises."""
    c = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return c
    v = c.try_cast(f.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"column {f.name} is no {f.dataType.simpleString()}: "), c))
    return F.when(c.isNull() | v.isNotNull(), v).otherwise(wrong.cast(f.dataType)).alias(f.name)


def write_csv(df: DataFrame, path: str, null_value: str = "(NULL)", single_file: bool = False,
              encoding: str = "UTF-8") -> str:
    """Header CSV, overwrite.  ``single_file`` coalesces to one partition (this
    removes write parallelism; only for small extracts)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("nullValue", null_value).option(
        "encoding", encoding).options(**QUOTING).csv(path)
    return path


def export_table(spark: SparkSession, table: str, path: str, single_file: bool = False) -> str:
    """`select * from table` written as header CSV (the Hive extract)."""
    return write_csv(spark.table(table), path, single_file=single_file)


def mapping_json(map_df: DataFrame, key_col: str = "level", value_col: str = "woe",
                 part: str = "feature") -> DataFrame:
    """Exported mapping form: one row per feature and level with a JSON object level -> value.

    A null level is written as the key "null"; where a feature also has a level
    of that name, the missing level's key is "(null)"."""
    level = F.col(key_col).cast("string")
    named = map_df.where(level == "null").select(part).distinct().withColumn("__named", F.lit(True))
    key = F.coalesce(level, F.when(F.col("__named"), F.lit("(null)")).otherwise(F.lit("null")))
    return map_df.join(named, part, "left").select(part, F.to_json(F.create_map(key, F.col(value_col))).alias("mapping"))
