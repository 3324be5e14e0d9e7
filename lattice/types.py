"""The closed set of types, schemas, derived columns, and the reading of literals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.errors import Invalid, Malformed

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z")
_PLAIN = {"bool": "boolean", "int64": "bigint", "float64": "double", "utf8": "string", "date": "date", "timestamp": "timestamp", "list<utf8>": "array<string>", "list<int64>": "array<bigint>"}


@dataclass(frozen=True)
class Type:
    kind: str  # a key of _PLAIN, or "decimal"
    precision: int = 0
    scale: int = 0

    @property
    def is_list(self) -> bool:
        return self.kind.startswith("list")

    @property
    def is_number(self) -> bool:
        return self.kind in ("int64", "float64", "decimal")

    @property
    def sql(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.kind == "decimal" else _PLAIN[self.kind]

    def to_json(self) -> Any:
        return {"decimal": {"precision": self.precision, "scale": self.scale}} if self.kind == "decimal" else self.kind

    @classmethod
    def from_json(cls, j: Any) -> Type:
        if isinstance(j, str) and j in _PLAIN:
            return cls(j)
        if isinstance(j, dict) and list(j) == ["decimal"] and isinstance(d := j["decimal"], dict):
            p, s = d.get("precision"), d.get("scale")
            if set(d) == {"precision", "scale"} and isinstance(p, int) and isinstance(s, int) and 1 <= p <= 38 and 0 <= s <= p:
                return cls("decimal", p, s)
        raise Malformed(f"no type: {j!r}")


BOOL, INT64, FLOAT64, UTF8 = Type("bool"), Type("int64"), Type("float64"), Type("utf8")


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    nullable: bool = True
    part: str | None = None  # a derived column: the year or month ...
    of: str | None = None  # ... of this field


class Schema:
    def __init__(self, fields: list[Field]):
        self.fields = list(fields)
        self.by_name = {f.name: f for f in fields}
        if len(self.by_name) != len(self.fields):
            raise Malformed("two fields of one name")
        for f in self.fields:
            if not NAME.fullmatch(f.name) or f.name.startswith(("__og_", "__grouping_")):
                raise Malformed(f"no field name: {f.name!r}")
            if f.of is not None:
                source = self.by_name.get(f.of)
                if source is None or source.of is not None or source.type.kind not in ("date", "timestamp") or f.type != INT64 or f.part not in ("year", "month") or source.nullable and not f.nullable:
                    raise Malformed(f"field {f.name}: {f.part} of {f.of} can't be derived")

    def field(self, name: str) -> Field | None:
        return self.by_name.get(name)

    def narrowed(self, names: list[str]) -> Schema:
        """What a client sees of an allowlist: derivations do not show."""
        return Schema([Field(f.name, f.type, f.nullable) for f in self.fields if f.name in names])

    def to_json(self) -> list[dict]:
        return [{"name": f.name, "type": f.type.to_json(), "nullable": f.nullable} | ({"from": {"part": f.part, "field": f.of}} if f.of else {}) for f in self.fields]

    @classmethod
    def from_json(cls, j: list[dict]) -> Schema:
        out = []
        for f in j:
            if not isinstance(f, dict) or set(f) - {"name", "type", "nullable", "from"}:
                raise Malformed(f"no field: {f!r}")
            d = f.get("from") or {}
            out.append(Field(f["name"], Type.from_json(f["type"]), bool(f.get("nullable", False)), d.get("part"), d.get("field")))
        return cls(out)


def of_spark(t: T.DataType) -> Type | None:
    """The type of a Spark column, or None for one that has no counterpart."""
    if isinstance(t, T.DecimalType):
        return Type("decimal", t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return {"string": Type("list<utf8>"), "bigint": Type("list<int64>"), "int": Type("list<int64>")}.get(t.elementType.simpleString())
    names = {"boolean": "bool", "tinyint": "int64", "smallint": "int64", "int": "int64", "bigint": "int64", "float": "float64", "double": "float64", "string": "utf8", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}
    kind = names.get(t.simpleString())
    return Type(kind) if kind else None


def propose(df: DataFrame) -> tuple[Schema, list[str]]:
    """A schema for a DataFrame, and the columns left out because their type has no counterpart."""
    fields, left = [], []
    for f in df.schema:
        t = of_spark(f.dataType)
        if t is None or not NAME.fullmatch(f.name):
            left.append(f.name)
        else:
            fields.append(Field(f.name, t, f.nullable))
    return Schema(fields), left


def shaped(df: DataFrame, schema: Schema) -> DataFrame:
    """df with exactly the schema's columns, in its types; derived columns computed (in UTC)."""
    stored = df.select(*[F.col(f.name).cast(f.type.sql).alias(f.name) for f in schema.fields if f.of is None])
    derived = {f.name: {"year": F.year, "month": F.month}[f.part](F.col(f.of)).cast("bigint") for f in schema.fields if f.of}
    return stored.withColumns(derived).select(*[f.name for f in schema.fields]) if derived else stored


def literal(value: Any, t: Type, path: str) -> Any:
    """The literal as a Python value of the type (None stays None); Invalid(ValueTypeMismatch) if it isn't one.

    Decimals, dates and timestamps are strings; an integer is also a decimal and a float; a float is never a decimal,
    and a decimal is rescaled exactly or refused.
    """

    def refuse(why: str = "") -> Invalid:
        return Invalid(f"{value!r} is no {t.sql}{why and ': ' + why}", "ValueTypeMismatch", path)

    if value is None:
        return None
    if t.kind == "bool":
        if not isinstance(value, bool):
            raise refuse()
        return value
    if isinstance(value, bool):
        raise refuse()
    if t.kind == "int64":
        if not isinstance(value, int) or not -(2**63) <= value < 2**63:
            raise refuse()
        return value
    if t.kind == "float64":
        if isinstance(value, str) and value in ("NaN", "Infinity", "-Infinity") or isinstance(value, int | float):
            return float(value)
        raise refuse()
    if t.kind == "decimal":
        if not isinstance(value, int | str):
            raise refuse()
        try:
            d = Decimal(value)
            exact = d.is_finite() and re.fullmatch(r"-?\d+(\.\d+)?", str(value)) and d == round(d, t.scale) and len(str(abs(int(d.scaleb(t.scale))))) <= t.precision
        except InvalidOperation:
            exact = False
        if not exact:
            raise refuse("not exactly")
        return round(d, t.scale)
    if not isinstance(value, str):
        raise refuse()
    if t.kind in ("date", "timestamp"):
        try:
            if not (_DATE if t.kind == "date" else _TIME).fullmatch(value):
                raise ValueError
            return dt.date.fromisoformat(value) if t.kind == "date" else dt.datetime.fromisoformat(value)
        except ValueError:
            raise refuse() from None
    return value


def column_of(value: Any, t: Type) -> Column:
    """A read literal as a column of the type."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat()).cast("timestamp")
    return F.lit(value).cast(t.sql)
