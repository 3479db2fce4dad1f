"""Writers and the guard every one of them passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _names(data_type: T.DataType) -> list[str]:
    if isinstance(data_type, T.StructType):
        return [n for f in data_type.fields for n in [f.name, *_names(f.dataType)]]
    if isinstance(data_type, T.ArrayType):
        return _names(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _names(data_type.valueType)
    return []


def assert_no_raw(df: DataFrame) -> DataFrame:
    """Refuse a frame that still carries a raw match at any depth of its schema."""
    if "raw" in _names(df.schema):
        raise ValueError("a raw match must never reach a sink")
    return df


def write_proofs(proofs: DataFrame, path: str, day: str = "generated_day") -> None:
    """Append gate proofs, partitioned by the day of the run."""
    dated = proofs if day in proofs.columns else proofs.withColumn(day, F.current_date())
    assert_no_raw(dated).write.mode("append").partitionBy(day).parquet(path)
