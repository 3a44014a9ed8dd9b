"""Readers and writers of the sandbox's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sojourn.functions import literals
from sojourn.operators import windows


def with_row_id(df: DataFrame) -> DataFrame:
    """row_id that grows with the place in the files: the order that first-match lookups keep."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def complete_csv(spark: SparkSession, path: str, columns: list[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV whose rows are complete in all of the file's columns, then projected."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return with_row_id(df).na.drop().select("row_id", *columns)


def projected_csv(spark: SparkSession, path: str, columns: list[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV projected first, then complete in what is left."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return with_row_id(df).select("row_id", *columns).na.drop(subset=columns)


def raw_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """CSV with all rows, columns renamed."""
    return with_row_id(spark.read.option("header", True).option("inferSchema", True).csv(path)).withColumnsRenamed(names or {})


def dated(df: DataFrame, column: str, form: str = "dd-MM-yyyy", pattern: str = r"^\d{2}-\d{2}-\d{4}$") -> DataFrame:
    """Rows whose date has the form, as dates."""
    ok = df.where(F.col(column).rlike(pattern))
    return ok.withColumn(column, F.try_to_timestamp(column, F.lit(form)).cast("date")).where(F.col(column).isNotNull())


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines without blank and broken ones; the last row of a key stays."""
    lines = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
    rows = lines.where(F.trim("value") != "").withColumn("_j", F.from_json("value", schema, {"mode": "PERMISSIVE"})).select("_j.*", "row_id").where(F.col(key).isNotNull())
    return windows.latest(rows, [key], [F.desc("row_id")])


def examples(spark: SparkSession, path: str, stem: str, known: list[str]) -> DataFrame:
    """id, query, other known fields and the rest as a map; rows without a query go, a missing id is made of stem and place."""
    rows = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = rows.withColumn("m", F.from_json("value", "map<string,string>")).where(F.col("m")["query"].isNotNull())
    placed = windows.global_rank(rows, [(F.col("row_id"), False)], "_i").withColumn("_i", (F.col("_i") - 1).cast("int"))
    made = F.coalesce(F.col("m")["id"], F.format_string(f"{stem}_%05d", "_i"))
    return placed.select(made.alias("id"), *(F.col("m")[k].alias(k) for k in known), F.map_filter("m", lambda k, v: ~k.isin("id", *known)).alias("metadata"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """city, state of a file of tab-separated lines."""
    return spark.read.option("sep", "\t").schema("city string, state string").csv(path)


def fanned(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(f"{value}s"))


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file, with its name, in the order of names."""
    return spark.read.option("multiLine", True).schema(schema).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def catalogue(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, column, kind of each file that is there, from headers."""
    rows = []
    for name, path in paths.items():
        try:
            rows += [(name, f.name, f.dataType.simpleString()) for f in spark.read.option("header", True).csv(path).schema]
        except Exception as error:  # noqa: BLE001  a missing file is no error here
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return spark.createDataFrame(rows, "table string, column string, kind string")


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def numbered_documents(df: DataFrame, order: list, name: str) -> DataFrame:
    """document, body: a numbered name and the JSON of each row."""
    placed = windows.global_rank(df, [(F.col(c), False) for c in order], "_i")
    return placed.select(F.format_string(f"{name}_%d.json", "_i").alias("document"), F.to_json(F.struct(*df.columns)).alias("body"))


def first_rows(df: DataFrame, order: list[Column | str], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def parsed_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell as JSON text: what it says as JSON, else as a literal (quotes of both kinds, escapes, tuples, sets, None, True, False), else
    the text itself."""
    return df.select(*(literals.value(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
