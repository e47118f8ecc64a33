"""Whether the rows of a SELECT fit the sink, and which joins the strict mode has."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType, VariantType

from weirflow.catalog import DELETE, KEY, OP, Catalog, Source

#: Types that take each other's values (fixed values).
SAME = ({"string", "char", "varchar"}, {"int", "bigint", "smallint", "tinyint"}, {"float", "double"})


class ValidationError(ValueError):
    """Rows that do not fit a sink."""


def compatible(a: DataType, b: DataType) -> bool:
    """Whether a value of type ``a`` can go into a field of type ``b``."""
    if isinstance(a, (NullType, VariantType)) or isinstance(b, VariantType):
        return True
    if isinstance(a, StructType) and isinstance(b, StructType):
        other = {f.name: f.dataType for f in b}
        return all(f.name in other and compatible(f.dataType, other[f.name]) for f in a)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return compatible(a.elementType, b.elementType)
    if isinstance(a, MapType) and isinstance(b, MapType):
        return compatible(a.keyType, b.keyType) and compatible(a.valueType, b.valueType)
    x, y = a.simpleString().split("(")[0], b.simpleString().split("(")[0]
    return x == y or any(x in s and y in s for s in SAME)


def output(schema: StructType, sink: Source, name: str = "sink") -> None:
    """Every selected field is in the sink with a compatible type, every non-optional field of the sink is selected."""
    fields = {f.name: f.dataType for f in schema if f.name not in (KEY, OP)}
    if OP in schema.names:
        if set(schema.names) != {KEY, OP}:
            raise ValidationError(f"a {DELETE} selects {KEY} and {OP} only")
        return
    if sink.schema is None:
        return
    want = {f.name: f.dataType for f in sink.schema}
    for f, kind in fields.items():
        if f not in want:
            raise ValidationError(f"field {f} is not in {name}")
        if not compatible(kind, want[f]):
            raise ValidationError(f"field {f} is {kind.simpleString()}; {name} has {want[f].simpleString()}")
    for f in want:
        if f not in fields and f not in sink.optional:
            raise ValidationError(f"{name} needs the field {f}")


def underline(sql: str, line: int, column: int, end: int | None = None) -> str:
    """``sql`` with a line of carets below the place of an error; line and column count from 1."""
    out = sql.split("\n")
    out.insert(line, "-" * (column - 1) + "^" * max(1, (end or column) - column + 1))
    return "\n".join(out)


def strict_join(catalog: Catalog, left: str, right: str, how: str, condition: str) -> None:
    """Raise for joins that only the superset has: two streams, two tables, FULL, CROSS, a table on the kept side."""
    kinds = [catalog.kind(left) != "stream", catalog.kind(right) != "stream"]
    how = how.lower()
    if how in ("full", "cross") or not condition.strip():
        raise ValidationError(f"{how} join")
    if kinds[0] == kinds[1]:
        raise ValidationError("a join is between a stream and a table")
    if how == "left" and kinds[0] or how == "right" and kinds[1]:
        raise ValidationError(f"a {how} join keeps the stream's rows")
    if " or " in condition.lower() or any(x in condition for x in ("<", ">", "!=")):
        raise ValidationError("a join condition is a conjunction of equalities")
