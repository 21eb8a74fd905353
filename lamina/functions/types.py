"""Declared column types, their Spark types, literal coercion and write guards.

Spark has no unsigned integers and no UUID: those widen to the next type that holds their
domain, and the domain is enforced on every write.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import InvalidValue, UnsupportedType


@dataclass(frozen=True)
class LogicalType:
    name: str
    spark: T.DataType
    least: int | None = None
    most: int | None = None

    @property
    def is_integer(self) -> bool:
        return self.least is not None


def _integers() -> dict[str, LogicalType]:
    signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
    wider = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
    out = {f"Int{n}": LogicalType(f"Int{n}", t, -(2 ** (n - 1)), 2 ** (n - 1) - 1) for n, t in signed.items()}
    return out | {f"UInt{n}": LogicalType(f"UInt{n}", t, 0, 2**n - 1) for n, t in wider.items()}


TYPES: dict[str, LogicalType] = {
    "String": LogicalType("String", T.StringType()),
    "UUID": LogicalType("UUID", T.StringType()),
    "Bool": LogicalType("Bool", T.BooleanType()),
    **_integers(),
}


def logical(name: str) -> LogicalType:
    """The type of this name; UUID is known in any case, others as spelled. ``spark:<ddl>`` passes a Spark type through."""
    if name.startswith("spark:"):
        return LogicalType(name, T._parse_datatype_string(name[6:]))
    found = TYPES.get("UUID" if name.upper() == "UUID" else name)
    if found is None:
        raise UnsupportedType(f"no column type {name}")
    return found


def of_spark(data_type: T.DataType) -> LogicalType:
    """The declared type that stands for a Spark type: for tables made from a DataFrame."""
    for t in TYPES.values():
        if t.spark == data_type and t.name != "UUID" and not t.name.startswith("U"):
            return t
    return LogicalType(f"spark:{data_type.simpleString()}", data_type)


def coerce(value: object, kind: LogicalType) -> object:
    """A literal as a value of ``kind``: strings for String and UUID, whole numbers for integers, booleans for Bool.

    There is no conversion between strings and numbers. None stays None.
    """
    if value is None:
        return None
    if kind.name == "String" and isinstance(value, str):
        return value
    if kind.name == "UUID" and isinstance(value, str):
        try:
            return str(uuid.UUID(value))
        except ValueError as e:
            raise InvalidValue(f"{value!r} is no UUID") from e
    if kind.name == "Bool" and isinstance(value, bool):
        return value
    if kind.is_integer and isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        if value != int(value) or not kind.least <= value <= kind.most:
            raise InvalidValue(f"{value} is not within {kind.name}")
        return Decimal(int(value)) if isinstance(kind.spark, T.DecimalType) else int(value)
    raise InvalidValue(f"{value!r} is no value of {kind.name}")


UUID_TEXT = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def guarded(column: Column, source: T.DataType, kind: LogicalType, name: str, nullable: bool) -> Column:
    """``column`` as ``kind``: a value outside the domain, or a NULL where none may be, fails the write.

    One expression inside the scan that feeds the write: no separate pass validates.
    """
    out = column
    if kind.is_integer:
        if not isinstance(source, (T.IntegralType, T.DecimalType)):
            raise InvalidValue(f"column {name}: {source.simpleString()} is no integer")
        wide = column.cast(T.DecimalType(38, 0)) if isinstance(source, T.DecimalType) else column
        outside = (wide < F.lit(Decimal(kind.least))) | (wide > F.lit(Decimal(kind.most)))
        if isinstance(source, T.DecimalType) and source.scale:
            outside = outside | (wide != column)
        out = F.when(outside, F.raise_error(F.concat(F.lit(f"column {name}: not within {kind.name}: "), column.cast("string"))))
        out = out.otherwise(column).cast(kind.spark)
    elif kind.name == "UUID":
        plain = F.lower(F.regexp_replace(column, "^urn:uuid:|[{}-]", ""))
        text = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        out = F.when(column.isNotNull() & ~text.rlike(UUID_TEXT), F.raise_error(F.concat(F.lit(f"column {name}: no UUID: "), column))).otherwise(text)
    elif source != kind.spark:
        raise InvalidValue(f"column {name}: {source.simpleString()} is no {kind.name}")
    if not nullable:
        out = F.when(out.isNull(), F.raise_error(F.lit(f"column {name} cannot be NULL"))).otherwise(out)
    return out
