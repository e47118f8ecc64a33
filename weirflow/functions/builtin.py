"""Built-in functions as columns, and the registry of user-defined scalar functions with overloads."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


class FunctionError(ValueError):
    """A call that a function does not take."""


def nested_field(df: DataFrame, column: str, path: str) -> Column:
    """The value at ``a.b[3].c`` below a column, as one column expression; NULL on the way gives NULL.

    A struct must have the field; a map key that is absent gives NULL; a list index counts from 0 and raises out of range.
    """
    kind: DataType = df.schema[column].dataType
    out = F.col(f"`{column}`")
    for name, index in _STEP.findall(path):
        if index:
            if not isinstance(kind, ArrayType):
                raise FunctionError(f"{path}: [{index}] is not in a list")
            out, kind = out[int(index)], kind.elementType
        elif isinstance(kind, StructType):
            if name not in kind.names:
                raise FunctionError(f"{path}: no field {name}")
            out, kind = out.getField(name), kind[name].dataType
        elif isinstance(kind, MapType):
            out, kind = out[F.lit(name)], kind.valueType
        else:
            raise FunctionError(f"{path}: {name} is not in a record")
    return out


def build_record(*arguments: Column | str) -> Column:
    """A nested record of name, value, name, value, ...; none gives an empty record."""
    if len(arguments) % 2:
        raise FunctionError("a record takes names and values")
    if not arguments:
        return F.expr("named_struct()")
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(str(k)) for k, v in zip(arguments[::2], arguments[1::2], strict=True)))


def regex_match(pattern: str | Column, text: Column) -> Column:
    """Whether all of ``text`` matches; the pattern comes first. NULL gives NULL."""
    if isinstance(pattern, str):
        return text.rlike(f"^(?:{pattern})$")
    return F.regexp(text, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def convert_to_string(x: Column) -> Column:
    return x.cast("string")


def flatten(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """A row per element of an array column. An empty array gives no row, NULL one row with NULL."""
    if not isinstance(df.schema[column].dataType, ArrayType):
        return df.withColumnRenamed(column, alias or column)
    c = F.col(f"`{column}`")
    rest = [F.col(f"`{x}`") for x in df.columns if x != column]
    return df.select(*rest, F.explode(F.when(c.isNull(), F.array(F.lit(None).cast(df.schema[column].dataType.elementType))).otherwise(c)).alias(alias or column))


@dataclass
class Overload:
    function: Callable
    params: tuple[str, ...]
    returns: str
    checked: bool = True


@dataclass
class Registry:
    """Scalar functions by lower-case name; an overload is chosen by the types of the arguments."""

    functions: dict[str, list[Overload]] = field(default_factory=dict)

    def udf(self, name: str, params: tuple[str, ...], returns: str, *, enabled: bool = True, checked: bool = True):
        """Register a function over pandas Series, called a batch at a time; NULLs reach it."""

        def wrap(f: Callable) -> Callable:
            if enabled:
                self.functions.setdefault(name.lower(), []).append(Overload(f, tuple(params), returns, checked))
            return f

        return wrap

    def call(self, df: DataFrame, name: str, *columns: str) -> Column:
        """A call with the overload that fits the columns' types."""
        found = self.functions.get(name.lower())
        if not found:
            raise FunctionError(f"no function {name}")
        kinds = [df.schema[c].dataType.simpleString() for c in columns]
        for o in found:
            if len(o.params) == len(kinds) and (not o.checked or all(p in ("any", k) or {p, k} <= {"int", "bigint"} for p, k in zip(o.params, kinds, strict=True))):
                return F.pandas_udf(o.function, o.returns)(*(F.col(f"`{c}`") for c in columns))
        raise FunctionError(f"{name} does not take ({', '.join(kinds)})")

    def register(self, spark: SparkSession) -> None:
        """Make the functions known to SQL. Overloads that return one type share their name, the types of the arguments choose; each has a name with its types as well."""
        for name, found in self.functions.items():
            if len(found) > 1:
                for o in found:
                    spark.udf.register(f"{name}_{'_'.join(o.params)}", F.pandas_udf(o.function, o.returns))
            if len(found) > 1 and len({o.returns for o in found}) == 1:
                spark.udf.register(name, F.arrow_udf(_chosen(name, found), found[0].returns))
            elif len(found) == 1:
                spark.udf.register(name, F.pandas_udf(found[0].function, found[0].returns))


#: Spark's names of types by those of Arrow.
_NAMES = {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "double": "double", "float": "float", "string": "string", "large_string": "string", "bool": "boolean", "binary": "binary", "date32[day]": "date"}


def _chosen(name: str, found: list[Overload]) -> Callable:
    """A function over Arrow arrays that calls the overload for their types."""

    def run(*arrays: pa.Array) -> pa.Array:
        kinds = [_NAMES.get(str(a.type), str(a.type)) for a in arrays]
        for o in found:
            if len(o.params) == len(kinds) and (not o.checked or all(p in ("any", k) or {p, k} <= {"int", "bigint"} for p, k in zip(o.params, kinds, strict=True))):
                return pa.Array.from_pandas(o.function(*(a.to_pandas() for a in arrays)))
        raise FunctionError(f"{name} does not take ({', '.join(kinds)})")

    # Spark tells by the hints that this is a function of arrays, and by its length how many there are
    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return run


REGISTRY = Registry()
