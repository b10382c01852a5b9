"""Files in and out: CSV with the usual dump options, nested JSON, and SQL dumps of INSERT statements."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, delimiter: str = ",", quote: str = '"', escape: str | None = None, null: str = "", header: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """A table from CSV files. A quote is doubled inside quotes unless there is another escape; fields may hold line ends.

    An unquoted field that equals ``null`` is NULL. The schema is given, never inferred, so the files are read once.
    """
    empty = "\x01"  # stands for a quoted empty text, which would be taken for NULL otherwise
    reader = spark.read.schema(schema).options(sep=delimiter, quote=quote, escape=escape or quote, nullValue=null, emptyValue=empty, header=header, encoding=encoding, multiLine=True, mode="FAILFAST")
    rows = reader.csv(path)
    return rows.select(*[F.when(F.col(c) == empty, "").otherwise(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in rows.dtypes])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', escape: str | None = None, null: str = "", header: bool = False, encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    """CSV files, one for each task. Empty texts are quoted, so that they come back as such."""
    df.write.mode(mode).options(sep=delimiter, quote=quote, escape=escape or quote, nullValue=null, emptyValue=quote * 2, header=header, encoding=encoding).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with NULL fields spelt out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


_INSERT = re.compile(r"insert\s+(?:ignore\s+)?into\s+(?:[`\"]?\w+[`\"]?\.)?[`\"]?(\w+)[`\"]?\s*(?:\(([^)]*)\))?\s*values\s*", re.IGNORECASE)
#: Comments at the start of lines, and whole quoted texts.
_QUOTED = re.compile(r"^\s*(?:--|#)[^\n]*$|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", re.MULTILINE | re.DOTALL)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def ends_in_text(statement: str) -> bool:
    """Whether a statement's end is inside quotes, so that it goes on after the semicolon."""
    rest = _QUOTED.sub("", statement)
    return any(c in rest for c in "'\"`")


def insert_rows(statement: str, table: str) -> list[list[str | None]]:
    """Field texts of the rows of an INSERT statement; none for another table or another statement."""
    m = _INSERT.match(statement.strip())
    if not m or m[1].lower() != table.lower():
        return []
    rows, row, field, text, at = [], None, [], False, m.end()
    body = statement.strip()
    quoted = ""
    while at < len(body):
        c = body[at]
        if quoted:
            if c == "\\" and at + 1 < len(body):
                at += 1
                field.append(_ESCAPES.get(body[at], body[at]))
            elif c == quoted:
                if body[at + 1 : at + 2] == quoted:
                    at += 1
                    field.append(c)
                else:
                    quoted = ""
            else:
                field.append(c)
        elif c in "'\"":
            quoted, text = c, True
            field = []
        elif row is None:
            if c == "(":
                row, field, text = [], [], False
        elif c in ",)":
            value = "".join(field)
            row.append(value if text else None if value.strip().upper() in ("NULL", "") else value.strip())
            field, text = [], False
            if c == ")":
                rows.append(row)
                row = None
        elif not text:
            field.append(c)
        at += 1
    return rows


def read_sql_dump(spark: SparkSession, path: str, table: str, schema: StructType | str) -> DataFrame:
    """The rows of one table in SQL dump files: its INSERT statements, each ended by a semicolon at a line's end.

    Files are split at those, so a dump of any size is read by many tasks; where one is inside quotes the statement goes on
    with the next part. If that is another task's, which needs such a text at a block's end, there is an error, and
    ``spark.sql.files.maxPartitionBytes`` must be larger. Fields are cast to the schema; text that does not fit gives NULL.
    Statements of other tables are left out.
    """
    own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches):
        open_ = ""
        for batch in batches:
            rows = []
            for s in batch["value"]:
                s = f"{open_};\n{s}" if open_ else s
                open_ = s if ends_in_text(s) else ""
                if not open_:
                    rows += insert_rows(s, table)
            yield pd.DataFrame({"fields": rows})
        if open_:
            raise ValueError("a quoted text with a semicolon at a line's end goes over the end of a block: read larger blocks")

    lines = spark.read.option("lineSep", ";\n").text(path).mapInPandas(run, "fields array<string>")
    return lines.select(*[F.get("fields", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(own.fields)])


def as_json(df: DataFrame, meta: bool = False) -> DataFrame:
    """A result as JSON texts, NULL fields spelt out; with ``meta`` each has the columns' names and types beside it."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    if not meta:
        return df.select(row.alias("json"))
    columns = F.lit("[" + ",".join(f'{{"name":"{n}","type":"{t}"}}' for n, t in df.dtypes) + "]")
    return df.select(F.concat(F.lit('{"columns":'), columns, F.lit(',"row":'), row, F.lit("}")).alias("json"))
