"""User functions: SQL functions with typed parameters, and host functions
whose failures become an error column."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.session import send_by_value


def define_function(spark: SparkSession, name: str, params: dict[str, str], body: str, returns: str) -> None:
    """A typed temporary SQL function, checked when it is defined and inlined by
    the optimizer where it is called."""
    typed = ", ".join(f"{p} {t}" for p, t in params.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({typed}) RETURNS {returns} RETURN {body}")


def host_function(function: Callable, returns: T.DataType | str) -> Callable[..., Column]:
    """A Python function as a Column function giving struct(value, error).

    ``function`` takes plain values, a row at a time, inside Arrow batches; where
    it raises, the value is NULL and the error holds the text.
    """
    declared = returns if isinstance(returns, str) else returns.simpleString()

    def over(*columns: Column) -> Column:
        value_type = to_arrow_type(T.DataType.fromDDL(declared))

        def call(*arrays: pa.Array) -> pa.Array:
            values, errors = [], []
            for row in zip(*[a.to_pylist() for a in arrays], strict=True):
                try:
                    values.append(function(*row))
                    errors.append(None)
                except Exception as failure:  # noqa: BLE001 - any failure of the function is its result
                    values.append(None)
                    errors.append(str(failure) or type(failure).__name__)
            return pa.StructArray.from_arrays([pa.array(values, value_type), pa.array(errors, pa.string())], names=["value", "error"])

        return F.arrow_udf(call, f"struct<value:{declared},error:string>")(*columns)

    return over


send_by_value(__name__)
