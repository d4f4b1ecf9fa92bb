"""Messy CSV files: header on any line, comments, wrong field counts, mixed null tokens, typed columns."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colforge.functions.infer import NULL_TOKENS, TYPES, ColumnType, blank_nulls, convert, infer_types
from colforge.operators.computed import row_id
from colforge.session import broadcast_if_small, materialize

DELIMITERS = (",", "\t", ";", "|")
LINE = ("__file", "__block", "__line")
PREVIEW_LINES = 50
# Different headers that the files of one folder may have; they are compared on the driver.
LAYOUTS = 1000


@dataclass
class CsvOptions:
    """`header_row` counts physical lines from 0; None means there is no header.

    `types` fixes types by column name (a kind, or a `ColumnType` with the order of day and month); other columns
    are inferred from all rows, and so is the order of declared dates; dates of both orders in one column are refused. `columns` keeps some columns. `text_null_as_empty` gives '' instead of NULL in text.
    """

    header_row: int | None = 0
    delimiter: str | None = None
    null_tokens: Sequence[str] = NULL_TOKENS
    types: dict[str, str | ColumnType] = field(default_factory=dict)
    columns: Sequence[str] | None = None
    quotes: bool = True
    comment: str = "#"
    text_null_as_empty: bool = False
    kinds: Sequence[str] = TYPES


@dataclass
class CsvTable:
    """Typed rows, the lines that were left out, and what was decided about the file."""

    rows: DataFrame
    rejects: DataFrame
    names: list[str]
    types: dict[str, ColumnType]
    delimiter: str


def infer_delimiter(line: str) -> str:
    """The delimiter that occurs most often in the line; a comma if none does."""
    counts = Counter({d: line.count(d) for d in DELIMITERS})
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def split_line(line: str, delimiter: str, quotes: bool = True) -> list[str]:
    kind = csv.QUOTE_MINIMAL if quotes else csv.QUOTE_NONE
    return [c.strip() for c in next(csv.reader([line], delimiter=delimiter, quoting=kind, skipinitialspace=True), [])]


def unique_names(names: Sequence[str]) -> list[str]:
    """Empty names become `col_<i>`; a repeated name gets `_1`, `_2`, … (compared without case)."""
    out, taken = [], set()
    for i, name in enumerate(names):
        base = name.strip() or f"col_{i}"
        candidate, k = base, 0
        while candidate.lower() in taken:
            k += 1
            candidate = f"{base}_{k}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def table_name(path: str) -> str:
    """File stem as a table name: letters, digits and `_`, never empty, never starting with a digit."""
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    name = re.sub(r"\W+", "_", stem).strip("_") or "table"
    return f"t_{name}" if name[0].isdigit() else name


def split_lines(lines: DataFrame, folder: str, names: list[str], options: CsvOptions, delimiter: str) -> tuple[DataFrame, DataFrame]:
    """(fields, rejects) of lines with their place: cells c0, c1, ... of `names` as texts, and the lines left out with the reason.

    The files begin with a header each, which names the columns in any order; a file with other columns is rejected.
    """
    below, headers = _after_header(lines, folder, [], 0)
    places = _places(names, headers, delimiter, options.quotes)
    return _good_fields(below, len(names), options, delimiter, places), _rejects(below, len(names), options, delimiter, places)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split and a number that rises within the split.

    Ordering by these three gives the order of the files, see `LINE`.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )


def preview(spark: SparkSession, path: str, n: int = PREVIEW_LINES) -> list[str]:
    """The first lines of a file; stops reading after the first split."""
    return [r["value"] for r in _first_lines(spark, path, n)]


def _first_lines(spark, path, n):
    return read_lines(spark, path).limit(n).collect()


def _headers(lines: DataFrame, header_row: int) -> DataFrame:
    """One row per file: `__cut`, the number of its header line, and `__header`, that line (NULL in a shorter file)."""
    ranked = lines.filter(F.col("__block") == 0).select(
        "__file", "__line", "value", F.row_number().over(Window.partitionBy("__file").orderBy("__line")).alias("n")
    )
    # The partial rank limit before the shuffle keeps header_row + 1 lines of each file.
    ranked = ranked.filter(F.col("n") <= header_row + 1)
    header = F.max(F.when(F.col("n") == header_row + 1, F.col("value")))
    return ranked.groupBy("__file").agg(F.max("__line").alias("__cut"), header.alias("__header"))


def _after_header(lines: DataFrame, path: str, head: list, header_row: int) -> tuple[DataFrame, list[str | None]]:
    """The lines below the header of every file, with `__layout`: the place of the file's header among the distinct ones."""
    if len(head) == header_row + 1 and all(r["__block"] == 0 and r["__line"] == i for i, r in enumerate(head)) and _is_file(lines.sparkSession, path):
        # One file: its first split is the first task, so the line number is the line's position.
        below = lines.filter((F.col("__block") > 0) | (F.col("__line") > header_row))
        return below.withColumn("__layout", F.lit(0)), [head[-1]["value"]]
    heads = materialize(_headers(lines, header_row))
    found = heads.groupBy("__header").count().limit(LAYOUTS + 1).collect()
    if len(found) > LAYOUTS:
        raise ValueError(f"the files have more than {LAYOUTS} different headers")
    # The header of most files comes first.
    known = [h for h, _ in sorted(found, key=lambda r: (r[0] is None, -r[1], r[0] or ""))]
    layout = F.coalesce(*[F.when(F.col("__header").eqNullSafe(F.lit(h)), F.lit(i)) for i, h in enumerate(known)])
    # Broadcast while it is small; beyond that the join is left to adaptive execution, which splits a very large file.
    joined = lines.join(broadcast_if_small(heads.select("__file", "__cut", layout.alias("__layout"))), "__file", "left")
    return joined.filter((F.col("__block") > 0) | (F.col("__line") > F.col("__cut"))).drop("__cut"), known


def _is_file(spark: SparkSession, path: str) -> bool:
    """True for a single file; folders and patterns are not looked into."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


def _places(names: list[str], headers: list[str | None], delimiter: str, quotes: bool) -> list[list[int] | None]:
    """For each header where the columns of `names` stand in it; None when it does not have exactly these columns."""
    out = []
    for header in headers:
        own = unique_names(split_line(header, delimiter, quotes)) if header is not None else []
        out.append([own.index(n) for n in names] if sorted(own) == sorted(names) else None)
    return out


def _fields(n: int, delimiter: str, quotes: bool) -> Column:
    """A line as a struct of n texts; `bad` is set when the field count is another."""
    schema = ", ".join([*(f"c{i} string" for i in range(n)), "bad string"])
    options = {
        "sep": delimiter,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "bad",
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "quote": '"' if quotes else "\0",
        "escape": '"' if quotes else "\0",
        "emptyValue": "",
        "nullValue": "\0",
        "maxCharsPerColumn": "-1",
    }
    return F.from_csv("value", schema, options)


def _skipped(comment: str) -> Column:
    """Why a line is no data line at all, else NULL."""
    value = F.trim("value")
    blank = F.when(value == "", F.lit("blank"))
    return blank.when(value.startswith(comment), F.lit("comment")) if comment else blank


def _good_fields(lines: DataFrame, n: int, o: CsvOptions, delimiter: str, places: list[list[int] | None]) -> DataFrame:
    """Place and fields of the data lines. `inline` over none or one struct parses every line once."""
    parsed = F.filter(F.array(_fields(n, delimiter, o.quotes)), lambda p: p["bad"].isNull())
    fit = [i for i, p in enumerate(places) if p is not None]
    rows = lines.filter(_skipped(o.comment).isNull() & F.col("__layout").isin(fit))
    rows = rows.select(*LINE, "__layout", F.inline(parsed)).drop("bad")
    if all(places[i] == list(range(n)) for i in fit):
        return rows.drop("__layout")

    def cell(k):
        return F.coalesce(*[F.when(F.col("__layout") == i, F.col(f"c{places[i][k]}")) for i in fit]).alias(f"c{k}")

    return rows.select(*LINE, *[cell(k) for k in range(n)])


def _rejects(lines: DataFrame, n: int, o: CsvOptions, delimiter: str, places: list[list[int] | None] | None = None) -> DataFrame:
    wrong = F.when(_fields(n, delimiter, o.quotes)["bad"].isNotNull(), F.lit("field count"))
    other = [i for i, p in enumerate(places or []) if p is None]
    strange = F.when(F.col("__layout").isin(other), F.lit("header")) if other else F.lit(None).cast("string")
    reasons = lines.withColumn("reason", F.coalesce(_skipped(o.comment), strange, wrong))
    return reasons.filter("reason IS NOT NULL").select(*LINE, "reason", "value")


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> CsvTable:
    """Read a file, or a folder of files with the same columns, into typed columns.

    Blank lines, comments and lines with a wrong field count are left out and listed in `rejects`. Columns are found
    by name in every file of a folder, whatever their order; the header of most files names them, and lines of a file
    with other columns are rejected for its header. The driver sees the first lines, the distinct headers and one row of facts (for the types).
    """
    o = options or CsvOptions()
    header_row = -1 if o.header_row is None else o.header_row
    head = _first_lines(spark, path, max(header_row + 1, 1))
    if len(head) <= header_row:
        raise ValueError(f"the file has only {len(head)} lines, no header at line {header_row}")
    first = head[-1]["value"] if head else ""
    lines = read_lines(spark, path)
    if header_row >= 0:
        lines, headers = _after_header(lines, path, head, header_row)
        first = headers[0] or ""
    delimiter = o.delimiter or infer_delimiter(first)
    cells = split_line(first, delimiter, o.quotes)
    names = unique_names(cells) if header_row >= 0 else [f"col_{i}" for i in range(len(cells))]
    unknown = [c for c in [*(o.columns or []), *o.types] if c not in names]
    if unknown:
        raise ValueError(f"no such column in the file: {', '.join(unknown)}; found {', '.join(names)}")

    if header_row >= 0:
        places = _places(names, headers, delimiter, o.quotes)
    else:
        lines, places = lines.withColumn("__layout", F.lit(0)), [list(range(len(names)))]
    rejects = _rejects(lines, len(names), o, delimiter, places)
    fields = _good_fields(lines, len(names), o, delimiter, places)
    cells = fields.select(*LINE, *[blank_nulls(F.col(f"c{i}"), o.null_tokens).alias(f"c{i}") for i in range(len(names))])

    wanted = [i for i, n in enumerate(names) if o.columns is None or n in o.columns]
    fixed = {n: t if isinstance(t, ColumnType) else ColumnType(t) for n, t in o.types.items()}
    types = {names[i]: fixed[names[i]] for i in wanted if names[i] in fixed}
    dates = {f"c{i}": types[names[i]].kind for i in wanted if names[i] in types and types[names[i]].kind in ("date", "datetime") and not types[names[i]].order}
    open_columns = [i for i in wanted if names[i] not in types or f"c{i}" in dates]
    if open_columns:
        found = infer_types(cells.select(*[f"c{i}" for i in open_columns]), [names[i] for i in open_columns], o.kinds, dates)
        types |= {names[i]: found[f"c{i}"] for i in open_columns}

    def column(i):
        kind = types[names[i]].kind
        value = convert(F.col(f"c{i}"), kind, types[names[i]].order)
        if kind == "text" and o.text_null_as_empty:
            value = F.coalesce(value, F.lit(""))
        return value.alias(names[i])

    rows = cells.select(*[column(i) for i in wanted], *LINE)
    return CsvTable(rows, rejects, [names[i] for i in wanted], {names[i]: types[names[i]] for i in wanted}, delimiter)


def read_simple(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    """A plain CSV file with whole-number, real and text columns only."""
    table = read_csv(spark, path, CsvOptions(0 if has_header else None, delimiter, kinds=("integer", "real", "text")))
    return table.rows.drop(*LINE)


def check_field_count(spark: SparkSession, path: str, expected: int, options: CsvOptions | None = None) -> None:
    """Raise when any data line has another number of fields than the table it should go to."""
    o = options or CsvOptions()
    header_row = -1 if o.header_row is None else o.header_row
    head = _first_lines(spark, path, max(header_row + 1, 1))
    delimiter = o.delimiter or infer_delimiter(head[-1]["value"] if head else "")
    lines = read_lines(spark, path)
    if header_row >= 0:
        lines, _ = _after_header(lines, path, head, header_row)
    bad = _rejects(lines, expected, o, delimiter).filter("reason = 'field count'")
    facts = bad.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*LINE, "value")).alias("first")).first()
    if facts["n"]:
        raise ValueError(f"{facts['n']} lines do not have {expected} fields, first: {facts['first']['value'][:200]!r}")


def wrong_field_counts(spark: SparkSession, path: str, expected: int, options: CsvOptions | None = None) -> DataFrame:
    """The data lines with another number of fields than `expected`: place, `row` (number of the line in its file, from 1), `fields`, `value`.

    Lines are numbered by a distributed scan, so that one long file may be counted by many tasks; blank lines, comments
    and the lines up to the header count. A file whose lines all fit gives no row, so an import may be checked by it.
    """
    o = options or CsvOptions()
    header_row = -1 if o.header_row is None else o.header_row
    head = _first_lines(spark, path, max(header_row + 1, 1))
    delimiter = o.delimiter or infer_delimiter(head[-1]["value"] if head else "")
    lines = read_lines(spark, path)
    wrong = _skipped(o.comment).isNull() & _fields(expected, delimiter, o.quotes)["bad"].isNotNull()
    # Narrow rows are numbered: the text of a line goes along only where it is wrong.
    marked = materialize(lines.select(*LINE, F.when(wrong, F.col("value")).alias("value")))
    numbered = row_id(marked, "row", order_by=list(LINE))
    first = numbered.groupBy("__file").agg(F.min("row").alias("__first"))
    bad = numbered.where("value IS NOT NULL").join(broadcast_if_small(first), "__file")
    bad = bad.withColumn("row", (F.col("row") - F.col("__first") + 1).cast("long")).where(F.col("row") > header_row + 1)
    bare = F.regexp_replace("value", r'"[^"]*"', "") if o.quotes else F.col("value")
    fields = F.size(F.split(bare, re.escape(delimiter), -1))
    return bad.select(*LINE, "row", fields.cast("long").alias("fields"), "value")


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder on any file system Spark can read; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return sorted(r["path"] for r in found.collect())


def read_folder(spark: SparkSession, folder: str, options: CsvOptions | None = None, pattern: str = "*.csv") -> dict[str, CsvTable]:
    """One table per file, named after the file. Names that clash get `_1`, `_2`, …"""
    paths = list_files(spark, folder, pattern)
    names = unique_names([table_name(p) for p in paths])
    return {n: read_csv(spark, p, options) for n, p in zip(names, paths)}
