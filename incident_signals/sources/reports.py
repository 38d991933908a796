"""Reading, completing, writing and exporting report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incident_signals import fixed_values as fixed
from incident_signals.functions.text import is_blank
from incident_signals.operators.numbering import numbered
from incident_signals.operators.reports import without_truth
from incident_signals.schema import RAW_REPORT_SCHEMA, require
from incident_signals.sources.csv_records import read_records


def read_reports_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_REPORT_SCHEMA, required: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Report CSV with a header, in any column order.

    Every token that means missing becomes null, known columns get their type
    (damaged values become null), other columns stay text.  Texts may hold quoted
    line breaks, and files are still split; ``multi_line=False`` saves a pass
    over them when no text does.
    """
    if multi_line:
        raw = _parsed(spark, path)
    else:
        raw = spark.read.csv(path, header=True, quote='"', escape='"', nullValue="")
    types = {f.name: f.dataType for f in schema.fields}

    def cell(name: str) -> Column:
        value = F.when(~F.col(f"`{name}`").isin(fixed.CSV_NULL_TOKENS), F.col(f"`{name}`"))
        kind = types.get(name, T.StringType())
        return (value if isinstance(kind, T.StringType) else value.try_cast(kind)).alias(name)

    out = raw.select(*[cell(name) for name in raw.columns])
    return require(out, required) if required else out


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    # the header is the first record of some file; no more of it is read for the names
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "nullValue": ""})
    return read_records(spark, path).where("NOT first").select(cells.alias("cells")).select("cells.*")


def read_reports_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """JSON array of reports, one task per file, or with ``lines`` one report per line, which splits; types are inferred without a schema."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def fill_defaults(
    df: DataFrame, defaults: dict[str, str] = fixed.PROCESSOR_DEFAULTS, order: list[str] | None = None,
    id_prefix: str = "REP-", blanks: bool = True,
) -> DataFrame:
    """Missing columns are added, missing cells filled (``blanks``), missing report ids numbered.

    Only rows without an id are numbered, in the given unique order or else as
    they are read, without moving the whole table through one task.
    """
    fill = {**defaults, "date": F.date_format(F.current_date(), "yyyy-MM-dd")}
    for name, default in fill.items():
        value = default if isinstance(default, Column) else F.lit(default)
        if name not in df.columns:
            df = df.withColumn(name, value)
        elif blanks:
            df = df.withColumn(name, F.when(is_blank(F.col(name).cast("string")), value).otherwise(F.col(name).cast("string")))
    if "report_id" not in df.columns:
        return _with_ids(df, order, id_prefix)
    ids = df.withColumn("report_id", F.col("report_id").cast("string"))
    if not blanks:
        return ids
    missing = is_blank(F.col("report_id"))
    return ids.where(~missing).unionByName(_with_ids(ids.where(missing).drop("report_id"), order, id_prefix))


def _with_ids(df: DataFrame, order: list[str] | None, prefix: str) -> DataFrame:
    rows = numbered(df, order, "_n", start=1)
    return rows.withColumn("report_id", F.format_string(f"{prefix}%05d", F.col("_n"))).drop("_n")


def drop_blank(df: DataFrame, text: str = "description") -> DataFrame:
    require(df, [text])
    return df.where(~is_blank(F.col(text)))


def intake_counts(df: DataFrame, text: str = "description") -> DataFrame:
    """Received, valid and skipped rows."""
    blank = is_blank(F.col(text))
    return df.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(~blank).alias("valid"), F.count_if(blank).alias("skipped")
    )


def write_enriched(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Enriched table at rest; as CSV on request, list columns as JSON text."""
    if file_format == "csv":
        lists = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        df.withColumns(lists).write.csv(path, header=True, quote='"', escape='"')
    else:
        df.write.parquet(path)


# Bytes of a row group of the report table: what a lookup reads at least.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def write_report_layout(df: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Report table that lookups and filters read in part.

    One folder per year of ``date`` (rows without a date have their own), in it
    rows in order of site and report id, range by range, so that a site's rows
    lie together and statistics of row groups skip other sites.  A bloom filter
    on ``report_id`` lets a lookup skip row groups whatever order they are in.
    """
    placed = df.withColumn("period", F.year(F.col("date").cast("date")))
    order = ["period", "site", "report_id"]
    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.write.partitionBy("period").option("parquet.block.size", str(row_group_bytes)).option(
        "parquet.bloom.filter.enabled#report_id", "true"
    ).parquet(path)


def read_report_layout(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """The table written above, of some years or of all; other years' files are not opened."""
    found = spark.read.parquet(path)
    return found.where(F.col("period").isin(years)) if years else found


def export_reports_csv(df: DataFrame, path: str) -> None:
    """Reports without truth columns."""
    write_enriched(without_truth(df), path, "csv")
