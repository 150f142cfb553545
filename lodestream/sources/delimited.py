"""Delimited text files: every value is a trimmed string until a typed reader converts it; what does not convert is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows of strings; a doubled quote is one, quoted values may hold line ends, rows without any value are left out.

    Names are those of the header in lower case, or ``columns``, or ``c0``, ``c1`` ...  ``strict`` raises on rows of another length.
    """
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("multiLine", True).option("header", header)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("inferSchema", False)
    if columns and not header:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    found = reader.csv(path)
    names = columns or ([c.strip().lower() for c in found.columns] if header else [f"c{k}" for k in range(len(found.columns))])
    found = found.toDF(*names)
    filled = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names]
    return found.select(*filled).filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`") != "" for c in names]))


def missing_headers(df: DataFrame, wanted: list[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [w for w in wanted if w.lower() not in have]


def as_string(df: DataFrame, name: str) -> Column:
    """A column by name, empty where the file has none of that name."""
    return F.col(f"`{name.lower()}`") if name.lower() in df.columns else F.lit("")


def as_int(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_string(df, name).try_cast("int"), F.lit(0))


def as_double(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_string(df, name).try_cast("double"), F.lit(0.0))


def as_date(df: DataFrame, name: str) -> Column:
    return dates.parse_date(as_string(df, name))


def field(value: Column, delimiter: str = ",", quote: str = '"', limit: int | None = None) -> Column:
    """A value as it stands in a file: trimmed, cut to a length, quoted only if it has to be."""
    text = F.coalesce(F.trim(value.cast("string")), F.lit(""))
    if limit is not None:
        text = F.rtrim(F.substring(text, 1, limit))
    quoted = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    return F.when(F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)) | text.rlike("[\\r\\n]"), quoted).otherwise(text)


def upper_quoted(value: Column, quote: str = '"') -> Column:
    """A value in capitals, always quoted."""
    text = F.upper(F.coalesce(F.trim(value.cast("string")), F.lit("")))
    return F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))


def read_raw(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", quote: str = '"', expect: int | None = None) -> DataFrame:
    """Rows that take one line each: ``raw``, the line as it stands, ``n_fields``, and the values by name.

    With ``expect`` a row of another number of fields raises.
    """
    lines = spark.read.text(path).select(F.col("value").alias("raw")).filter(F.trim("raw") != "")
    bare = F.regexp_replace("raw", f"{quote}(?:[^{quote}]|{quote}{quote})*+{quote}", "")
    number = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    if expect is not None:
        number = F.when(number == expect, number).otherwise(F.raise_error(F.concat(F.lit(f"not {expect} fields: "), F.col("raw"))).cast("int"))
    parsed = F.from_csv("raw", F.lit(", ".join(f"`{c}` string" for c in columns)), {"sep": delimiter, "quote": quote, "escape": quote})
    return lines.select("raw", number.alias("n_fields"), parsed.alias("v")).select("raw", "n_fields", *[F.coalesce(F.trim(F.col(f"v.`{c}`")), F.lit("")).alias(c) for c in columns])


def no_zero(value: Column) -> Column:
    return F.when(value != 0, value.cast("string")).otherwise("")


def date_field(value: Column, pattern: str = "MM/dd/yyyy") -> Column:
    return dates.format_date(value, pattern)


def line(*fields: Column, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *fields)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, append: bool = False, gather: bool = False) -> None:
    """One file per task under ``path``; ``gather`` makes a single file of a small result."""
    fields = [field(F.col(f"`{c}`"), delimiter, quote) for c in df.columns]
    lines = df.select(line(*fields, delimiter=delimiter).alias("value"))
    if header:
        first = line(*[field(F.lit(c), delimiter, quote) for c in df.columns], delimiter=delimiter)
        lines = lines.mapInArrow(_headed(df.sparkSession.range(1).select(first).first()[0]), "value string")
    (lines.coalesce(1) if gather else lines).write.mode("append" if append else "error").text(path)


def _headed(header: str):
    """Puts a header before the rows of every task that has any."""

    def run(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if batch.num_rows and first:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    return run


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
