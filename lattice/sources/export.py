"""Results as text: value notation, CSV and JSON lines and files, pivots, and pages for a client. All formatting is done by Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.errors import LimitExceeded, Malformed
from lattice.operators.pivot import PivotResult
from lattice.runtime import with_rank
from lattice.types import Type, of_spark


@dataclass(frozen=True)
class CsvFormat:
    delimiter: str = ","
    null: str = ""
    bom: bool = True
    guard_formulas: bool = True
    headers: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.delimiter) != 1 or self.delimiter in "\"\r\n" or any(c in self.null for c in "\"\r\n" + self.delimiter):
            raise Malformed("a delimiter is one character, and nulls are spelled without quotes, line ends and delimiters")


def notation(c: Column, t: Type) -> Column:
    """A value as text: exact decimals, ISO dates and times (fractions only if there are any), lists as JSON."""
    if t.kind == "timestamp":
        fraction = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), F.rtrim(fraction, F.lit("0")))), F.lit("Z"))
    if t.is_list:
        return F.to_json(c)
    return c.cast("string")


def _types(df: DataFrame) -> dict[str, Type]:
    return {f.name: of_spark(f.dataType) for f in df.schema}


def _quoted(c: Column, f: CsvFormat, text: bool) -> Column:
    """A cell: guarded against being read as a formula, quoted where it must be; the empty string is quoted."""
    if not text:
        return c
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c) if f.guard_formulas else c
    special = F.lit(False)
    for x in {f.delimiter, '"', "\r", "\n", *((",", ";", "\t") if f.guard_formulas else ())}:
        special = special | F.contains(guarded, F.lit(x))
    needs = special | (guarded == "") | (guarded == f.null) | guarded.rlike(r"^\s|\s$")
    return F.when(needs, F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def csv_lines(df: DataFrame, f: CsvFormat = CsvFormat()) -> DataFrame:
    """One column `line`: the rows as CSV (without header), in the order of df."""
    return df.select(_csv_line(_types(df), f).alias("line"))


def _cell(c: str, t: Type, f: CsvFormat) -> Column:
    return F.coalesce(_quoted(notation(F.col(c), t), f, t.kind == "utf8" or t.is_list), F.lit(f.null))


def _csv_line(types: dict[str, Type], f: CsvFormat) -> Column:
    return F.concat_ws(f.delimiter, *[_cell(c, t, f) for c, t in types.items()])


def csv_header(names: list[str], f: CsvFormat = CsvFormat()) -> str:
    def cell(n: str) -> str:
        n = f.headers.get(n, n)
        if f.guard_formulas and n[:1] in ("=", "+", "-", "@", "\t", "\r"):
            n = "'" + n
        return '"' + n.replace('"', '""') + '"' if any(x in n for x in f.delimiter + '"\r\n,;\t') or not n else n

    return ("﻿" if f.bom else "") + f.delimiter.join(map(cell, names)) + "\r\n"


def json_rows(df: DataFrame) -> DataFrame:
    """One column `line`: each row as a JSON object; decimals, times and what JSON has no number for are strings."""
    return df.select(_json_line(_types(df)).alias("line"))


def _json_line(types: dict[str, Type]) -> Column:
    parts = []
    for c, t in types.items():
        v = notation(F.col(c), t) if t.kind in ("decimal", "date", "timestamp") else F.col(c)
        written = F.to_json(F.struct(v.alias("x")))  # NaN and the infinities come out as strings
        parts.append(F.concat(F.lit(f'"{c}":'), F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(written, r"(?s)^\{\"x\":(.*)\}$", 1))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def flat_columns(df: DataFrame) -> DataFrame:
    """A flat tree's rows as they are exported: the path's keys from the root down in one text, as in `1 / 2 / 4`."""
    return df.withColumn("path", F.array_join("path", " / "))


def _bounded(df: DataFrame, at_most: int) -> int:
    n = df.count()
    if n > at_most:
        raise LimitExceeded(f"{n} rows; an export has {at_most} at most")
    return n


def write_lines(lines: DataFrame, path: str, at_most: int = 1_000_000) -> int:
    """Lines as text files, refused beyond at_most rows before anything is written."""
    n = _bounded(lines, at_most)
    lines.write.option("lineSep", "\r\n").text(path)
    return n


def _one_file(lines: DataFrame, path: str, ending: str) -> None:
    """Rows (line, position) as one text file in a folder; the caller has bounded their number."""
    lines.repartition(1).sortWithinPartitions("position").select("line").write.option("lineSep", ending).text(path)


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    return with_rank(df, *order, name="position") if order else df.withColumn("position", F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, f: CsvFormat = CsvFormat(), order: list[Column] = [], at_most: int = 1_000_000) -> int:
    """One CSV file with its header (and byte order mark, if asked for), lines ended by CRLF, in the order given; refused beyond at_most rows."""
    n = _bounded(df, at_most)
    rows = _placed(df, order)
    lines = rows.select(_csv_line(_types(df), f).alias("line"), "position")
    head = df.sparkSession.createDataFrame([(csv_header(df.columns, f).removesuffix("\r\n"), -1)], "line string, position long")
    _one_file(head.unionByName(lines), path, "\r\n")
    return n


def write_json(df: DataFrame, path: str, order: list[Column] = [], at_most: int = 1_000_000) -> int:
    """One file that holds an array of row objects, one a line, in the order given; refused beyond at_most rows."""
    n = _bounded(df, at_most)
    rows = with_rank(df, *order, name="position") if order else with_rank(df, F.monotonically_increasing_id(), name="position")
    lines = rows.select(_json_line(_types(df)).alias("line"), "position")
    lines = lines.withColumn("line", F.when(F.col("position") == n - 1, F.col("line")).otherwise(F.concat("line", F.lit(","))))
    ends = df.sparkSession.createDataFrame([("[", -1), ("]", n)], "line string, position long")
    _one_file(ends.unionByName(lines), path, "\n")
    return n


def to_wire(df: DataFrame, total: int, at_most: int = 10_000) -> dict:
    """A page as columns of JSON values, for a client; a page of over at_most rows is refused."""
    types = _types(df)
    text = {c: t for c, t in types.items() if t.kind in ("decimal", "date", "timestamp")}
    rows = df.select(*[notation(F.col(c), t).alias(c) if c in text else F.col(c) for c, t in types.items()]).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise LimitExceeded(f"a page has {at_most} rows at most")
    special = lambda v: v if v is None or v - v == 0 else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    columns = [{"name": c, "type": t.to_json(), "values": [special(r[i]) if t.kind == "float64" else r[i] for r in rows]} for i, (c, t) in enumerate(types.items())]
    return {"total_count": total, "row_count": len(rows), "columns": columns}


@dataclass(frozen=True)
class PivotLabels:
    """The words of a pivot's file; {} is the value of the group that a subtotal closes."""

    total: str = "Total"
    subtotal: str = "Total {}"
    null: str = "(null)"
    empty: str = "(empty)"


def pivot_header(p: PivotResult, f: CsvFormat = CsvFormat(), labels: PivotLabels = PivotLabels()) -> str:
    """Headers of a pivot's columns: the path, the measure and what it shows, as in `2025 · total · share of row`."""
    said = lambda v: labels.null if v is None else labels.empty if v == "" else str(v)
    names = [*p.rows, *(" · ".join([*map(said, c["path"]), c["measure"], *([c["calc"].replace("_", " ")] if "calc" in c else [])]) for c in p.columns)]
    return csv_header(names, f)


def pivot_lines(p: PivotResult, f: CsvFormat = CsvFormat(), labels: PivotLabels = PivotLabels()) -> DataFrame:
    """(line, position): a pivot's rows as CSV, in order. A subtotal has its label in the first dimension and leaves the others blank."""
    rows = _placed(p.all_rows, p.order)
    types = _types(p.all_rows)
    plain = {r: F.coalesce(F.when(notation(F.col(r), types[r]) == "", F.lit(labels.empty)).otherwise(notation(F.col(r), types[r])), F.lit(labels.null)) for r in p.rows}
    n, level, cells = len(p.rows), F.col("__level"), []
    for i, r in enumerate(p.rows):
        member = _quoted(plain[r], f, True)
        if i == 0:
            group = F.element_at(F.array(*plain.values()), F.greatest(level, F.lit(1)))
            before, _, after = labels.subtotal.partition("{}")
            label = F.when(level == 0, F.lit(labels.total)).otherwise(F.concat(F.lit(before), group, F.lit(after)))
            cells.append(F.when(level < n, _quoted(label, f, True)).otherwise(member))
        else:
            cells.append(F.when(level < n, F.lit("")).otherwise(member))
    cells += [_cell(c["name"], types[c["name"]], f) for c in p.columns]
    return rows.select(F.concat_ws(f.delimiter, *cells).alias("line"), "position")


def write_pivot_csv(p: PivotResult, path: str, f: CsvFormat = CsvFormat(), labels: PivotLabels = PivotLabels()) -> None:
    """One CSV file of a whole pivot, which its limits bound."""
    head = p.df.sparkSession.createDataFrame([(pivot_header(p, f, labels).removesuffix("\r\n"), -1)], "line string, position long")
    _one_file(head.unionByName(pivot_lines(p, f, labels)), path, "\r\n")


def pivot_to_wire(p: PivotResult, at_most: int = 10_001) -> dict:
    """A pivot as JSON values: the row dimensions, the columns' paths and measures, each row's level, and the result."""
    page = to_wire(p.df, 0, at_most)
    *columns, levels = page["columns"]
    return {"row_dimensions": list(p.rows), "columns": [{k: c[k] for k in ("path", "measure")} for c in p.columns], "levels": levels["values"], "result": page | {"total_count": page["row_count"], "columns": columns}}
