"""Tables whose parts are replaced by key: rows and the keys they stand for, under the number of the run that wrote them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.utils import AnalysisException


def write_generation(rows: DataFrame, touched: DataFrame, out: str, number: int, keys: list[str]) -> None:
    """The rows that take the place of all earlier ones with the touched keys; keys without rows are emptied.

    A run that is repeated overwrites just its own. The list of keys comes last: without it the rows do not count. Rows are
    sorted by key in their files, so readers of a few keys skip by the files' statistics; a folder for each key would be
    too many.
    """
    rows.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{out}/rows/run={number}")
    touched.select(*keys).distinct().write.mode("overwrite").parquet(f"{out}/touched/run={number}")


def _touched(spark: SparkSession, out: str, form: StructType, keys: list[str]) -> DataFrame | None:
    kinds = ", ".join(f"`{k}` {form[k].dataType.simpleString()}" for k in keys)
    try:
        return spark.read.schema(f"{kinds}, run long").parquet(f"{out}/touched")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_generations(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows that count now: those of each key from the last run that touched it. A table never written is empty."""
    form = _parse_datatype_string(schema)
    touched = _touched(spark, out, form, keys)
    if touched is None:
        return spark.createDataFrame([], form)
    last = touched.groupBy(*keys).agg(F.max("run").alias("run"))
    rows = spark.read.schema(f"{schema}, run long").parquet(f"{out}/rows")
    return rows.join(last, [*keys, "run"], "left_semi").select(*form.names)


def next_run(spark: SparkSession, out: str, keys_form: str) -> int:
    """A number above those of all runs so far. keys_form: the keys with their types."""
    form = _parse_datatype_string(keys_form)
    touched = _touched(spark, out, form, form.names)
    return 0 if touched is None else (touched.agg(F.max("run")).head()[0] or 0) + 1
