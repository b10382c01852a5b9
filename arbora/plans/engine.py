"""A session that answers statements of the dialect: queries, tables, DML with RETURNING, prepared statements and cursors.

Tables are Spark's own (Parquet), in Spark's catalog. UPDATE and DELETE write a new copy and put it in the old one's place,
so they cost a rewrite of the table, as they do on immutable files. There are no transactions; constraints are kept as
facts about table groups and not enforced, but :meth:`Engine.orphans` finds the rows that violate one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import register
from ..operators import groups
from ..operators.sequences import Sequence
from ..sources import files, infoschema
from . import dialect
from .dialect import Token, closing, solid, split, text, tokens


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Soft errors for what is analysed inside: a zero divisor and a wrong cast give NULL. The session's own mode comes back."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


class Engine:
    def __init__(self, spark: SparkSession, schema: str = "default") -> None:
        self.spark = spark
        self.schema = schema
        self.definitions: dict[str, dialect.TableDefinition] = {}
        self.prepared: dict[str, str] = {}
        self.cursors: dict[str, tuple[DataFrame, Iterator[Row] | None]] = {}
        self.sequences: dict[str, Sequence] = {}
        self.procedures: dict[str, Callable[..., DataFrame]] = {}
        self.settings: dict[str, str] = {}
        self.views: dict[str, str] = {}
        self.functions: dict[str, tuple[str, bool]] = {}
        self.scratch: list[str] = []
        self.indexes: dict[str, tuple[str, bool, list[tuple[str, str]]]] = {}
        self.statistics: Counter[str] = Counter()
        self.last_statement: str | None = None
        register(spark)

    def close(self) -> None:
        """Drop the tables from which results of earlier statements are read."""
        while self.scratch:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.scratch.pop()}")

    # queries

    def sql(self, statement: str, parameters: list | tuple = ()) -> DataFrame:
        """The result of one statement; a statement without rows gives an empty frame or a count."""
        ts = solid(tokens(statement))
        first = ts[0].word
        self.statistics[first] += 1
        self.last_statement = statement
        own = getattr(self, f"_{first.lower()}", None)
        if own is not None:
            done = own(statement, ts, parameters)
            if done is not None:
                return done
        return self._run(statement, parameters)

    def script(self, statements: str) -> DataFrame | None:
        """Statements in turn; the last one's result."""
        out = None
        for s in dialect.statements(statements):
            out = self.sql(s)
        return out

    def explain(self, statement: str, mode: str = "formatted") -> str:
        plan = self._run(statement, ())
        return plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), mode)

    def _run(self, statement: str, parameters: list | tuple) -> DataFrame:
        if "VALUE FOR" in " ".join(statement.upper().split()):
            statement = dialect.sequences_named(statement)
        if "NEXTVAL" in statement.upper() and (numbered := self._numbered(statement, parameters)) is not None:
            return numbered
        with lenient(self.spark):
            return self.spark.sql(dialect.to_spark(self._catalog(self._numbers(statement))), args=list(parameters) or None)

    def _numbered(self, statement: str, parameters: list | tuple) -> DataFrame | None:
        """``SELECT ..., NEXTVAL('s') [AS name] ... FROM ...``: the next value for each row, in the rows' order; None without FROM."""
        ts = solid(tokens(statement))
        depth, end = 0, None
        for i, t in enumerate(ts):
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.word == "FROM" and end is None:
                end = i
        if ts[0].word != "SELECT" or end is None:
            return None
        items, sequences = [], {}
        for n, item in enumerate(split(ts[1:end], ",")):
            if any(t.word == "NEXTVAL" for t in item):
                stop = closing(item, 1) if item[0].word == "NEXTVAL" else 0
                rest = [t.word for t in item[stop + 1 :]]
                if item[0].word != "NEXTVAL" or not (not rest or len(rest) == 1 and item[-1].kind in ("name", "quoted") or len(rest) == 2 and rest[0] == "AS"):
                    raise ValueError("NEXTVAL stands alone in the list of a SELECT from tables")
                sequences[n] = self._sequence([t.text.strip("'\"`") for t in item[2:stop]])
                item = [Token("done", "CAST(NULL AS BIGINT)"), Token("name", "AS"), item[-1] if len(item) > stop + 1 else Token("name", "next_value")]
            items.append(" ".join(t.text for t in item))
        if not sequences:
            return None
        rest = " ".join(t.text for t in ts[end:])
        rows = self._run(f"SELECT {', '.join(items)} {rest}", parameters)
        names = rows.columns
        rows = self._kept(rows.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row_no", F.monotonically_increasing_id()), "numbered")
        for n, sequence in sequences.items():
            rows = sequence.number(rows, "row_no", f"c{n}")
        rows = rows.orderBy("row_no") if "ORDER" in {t.word for t in ts[end:]} else rows
        return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])

    def _sequence(self, given: list[str]) -> Sequence:
        return self.sequences[".".join(x for x in given if x not in (",", ".")).split(".")[-1].lower()]

    def _kept(self, df: DataFrame, tag: str) -> DataFrame:
        """The rows as a table that results may be read from, until :meth:`close`."""
        name = f"arb_{tag}_{uuid.uuid4().hex[:8]}"
        self._keep(name, df)
        self.scratch.append(name)
        return self.spark.table(name)

    def _catalog(self, statement: str) -> str:
        """Tables of ``information_schema`` replaced by frames of what the catalog holds now."""
        if "information_schema" not in statement.lower():
            return statement
        ts, out, at = tokens(statement), [], 0
        while at < len(ts):
            if ts[at].text.lower() == "information_schema" and at + 2 < len(ts) and ts[at + 1].text == ".":
                name = ts[at + 2].text.lower()
                infoschema.frame(self, name).createOrReplaceTempView(f"information_schema_{name}")
                out.append(f"information_schema_{name}")
                at += 3
            else:
                out.append(ts[at].text)
                at += 1
        return "".join(out)

    def _numbers(self, statement: str) -> str:
        """Calls that the driver answers, replaced by values; one value for a statement."""
        if not any(name in statement.upper() for name in ("VAL(", "VAL (", "CURRENT_SE", "COLUMN_TYPE_STRING", "SLEEP")):
            return statement
        ts = tokens(statement)
        quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
        out, at = [], 0
        while at < len(ts):
            word = ts[at].word
            called = at + 1 < len(ts) and ts[at + 1].text == "("
            end = closing(ts, at + 1) if called else at
            given = [t.text.strip("'\"`") for t in solid(ts[at + 2 : end]) if t.kind in ("text", "quoted", "name")]
            if called and word in ("NEXTVAL", "CURRVAL"):
                out.append(str(getattr(self._sequence(given), word.lower())()))
            elif called and word == "SLEEP":
                time.sleep(float(text(ts[at + 2 : end])))
                out.append("0")
            elif called and word == "CURRENT_SETTING":
                out.append(quoted(self.settings.get(given[0].lower(), self.spark.conf.get(given[0], None))))
            elif called and word == "COLUMN_TYPE_STRING":
                table, column = ".".join(given).split(".")[-2:]
                out.append(quoted(next(c.dataType.upper() for c in self.spark.catalog.listColumns(table) if c.name.lower() == column.lower())))
            elif word == "CURRENT_SESSION_ID":
                out.append(str(id(self)))
            else:
                out.append(ts[at].text)
                end = at
            at = end + 1
        return "".join(out)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "result string")

    def _select(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        """``SELECT ** FROM table [WHERE ...]``: rows with their whole branch as arrays of structs."""
        if [t.text for t in ts[1:3]] != ["*", "*"]:
            return None
        node = self.group(ts[4].text.strip('"`'))
        where = " ".join(t.text for t in ts[6:]) if len(ts) > 5 and ts[5].word == "WHERE" else "TRUE"
        node.rows.createOrReplaceTempView("group_root")
        rows = self._run(f"SELECT * FROM group_root AS {node.name} WHERE {where}", parameters)
        return groups.nested(groups.Node(node.name, rows, node.columns, None, node.children))

    def _values(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        return self._run(f"SELECT * FROM ({statement}) AS v", parameters)

    # tables

    def _create(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        kind = ts[1].word
        if kind == "TABLE":
            definition = dialect.table_definition(statement)
            if definition is None:  # CREATE TABLE AS
                at = next(i for i, t in enumerate(ts) if t.word == "AS")
                words = [t.word for t in ts]
                with_data = words[-3:] != ["WITH", "NO", "DATA"]
                end = len(ts) - (3 if not with_data else 2 if words[-2:] == ["WITH", "DATA"] else 0)
                name = ts[at - 1].text if ts[at - 1].text != ")" else ts[2].text
                df = self._run(" ".join(t.text for t in ts[at + 1 : end]), parameters)
                self._keep(name.strip('"`'), df if with_data else df.limit(0))
                return self._empty()
            self.definitions[definition.name.lower()] = definition
            for column, (start, step) in definition.identity.items():
                self.sequences[f"{definition.name}/{column}".lower()] = Sequence(start, step)
            self.spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in definition.columns)).write.format("parquet").saveAsTable(definition.name)
            return self._empty()
        if kind == "SEQUENCE":
            words = [t.word or t.text for t in ts]

            def after(*names: str, other: int | None = None) -> int | None:
                at = next((i + len(names) for i in range(len(words) - len(names)) if words[i : i + len(names)] == [*names]), None)
                return other if at is None else -int(words[at + 1]) if words[at] == "-" else int(words[at])

            cycle = "CYCLE" in words and words[words.index("CYCLE") - 1] != "NO"
            step = after("INCREMENT", "BY", other=1)
            low, high = after("MINVALUE"), after("MAXVALUE")
            start = after("START", "WITH", other=(1 if low is None else low) if step > 0 else (-1 if high is None else high))
            self.sequences[ts[2].text.split(".")[-1].lower()] = Sequence(start, step, low, high, cycle)
            return self._empty()
        if kind in ("INDEX", "UNIQUE", "GROUP"):  # there are no indexes; scans prune by file statistics
            words = [t.word for t in ts]
            if "ON" in words and "INDEX" in words:
                at = words.index("ON")
                opened = next((i for i in range(at, len(ts)) if ts[i].text == "("), None)
                if opened is not None:
                    listed = [([t for t in part if t.word not in ("ASC", "DESC")][-1].text.strip('"`'), "NO" if part[-1].word == "DESC" else "YES") for part in split(ts[opened + 1 : closing(ts, opened)], ",")]
                    self.indexes[ts[words.index("INDEX") + 1].text.strip('"`')] = ts[opened - 1].text.strip('"`'), "UNIQUE" in words, listed
            return self._empty()
        if kind == "VIEW":
            self.views[ts[2].text.strip('"`').lower()] = text(tokens(statement)[next(i for i, t in enumerate(tokens(statement)) if t.word == "AS") + 1 :])
            self.spark.sql(dialect.to_spark(statement).replace("CREATE VIEW", "CREATE TEMPORARY VIEW", 1))
            return self._empty()
        if kind in ("PROCEDURE", "FUNCTION") or "FUNCTION" in [t.word for t in ts[:4]] or "PROCEDURE" in [t.word for t in ts[:4]]:
            return self._routine(ts)
        return None

    def _routine(self, ts: list[Token]) -> DataFrame | None:
        """``CREATE [OR REPLACE] FUNCTION f(x INT) RETURNS INT LANGUAGE SQL ... AS 'x + 1'``, and PROCEDURE with a statement of ``$1``, ``$2``."""
        words = [t.word for t in ts]
        if "LANGUAGE" not in words or words[words.index("LANGUAGE") + 1] != "SQL":
            return None
        at = next(i for i, w in enumerate(words) if w in ("FUNCTION", "PROCEDURE"))
        name, end = ts[at + 1].text.strip('"`'), closing(ts, at + 2)
        last = ts[-1].text
        body = last[2:-2] if last.startswith("$$") else last[1:-1].replace("''", "'")
        if words[at] == "PROCEDURE":
            self.procedure(name, lambda spark, *given: self._executed(body, list(given)))
            return self._empty()
        parameters = ", ".join(f"{part[0].text} {dialect.column_type(part[1:])}" for part in split(ts[at + 3 : end], ",") if part)
        result = dialect.column_type(ts[words.index("RETURNS") + 1 : words.index("LANGUAGE")])
        define = lambda own: self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({parameters}) RETURNS {result} RETURN {dialect.to_spark(body)}")
        with lenient(self.spark):
            try:
                define(name)
            except AnalysisException as e:
                if "CANNOT_REPLACE_NON_SQL_UDF" not in (e.getCondition() or ""):
                    raise
                # Spark puts it in place of another SQL function only; a Python function goes once the new one is known to be sound
                define(trial := f"arb_trial_{uuid.uuid4().hex}")
                for gone in (trial, name):
                    self.spark.sql(f"DROP TEMPORARY FUNCTION {gone}")
                define(name)
        self.functions[name.lower()] = (result, True)
        return self._empty()

    def _executed(self, statement: str, given: list) -> DataFrame:
        """A statement with ``$1``, ``$2`` ... or ``?`` for values."""
        inner = tokens(statement)
        places = [int(t.text[1:]) for t in inner if t.kind == "place"]
        return self.sql("".join("?" if t.kind == "place" else t.text for t in inner), [given[n - 1] for n in places] or given)

    def _rename(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        """``RENAME TABLE a TO b``; definitions and the children's keys follow."""
        old, new = ts[2].text.strip('"`'), ts[-1].text.strip('"`')
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
        if (own := self.definitions.pop(old.lower(), None)) is not None:
            own.name = new
            self.definitions[new.lower()] = own
            for column in own.identity:
                self.sequences[f"{new}/{column}".lower()] = self.sequences.pop(f"{old}/{column}".lower())
        for child in self.definitions.values():
            child.parents = [(new if to.lower() == old.lower() else to, *rest) for to, *rest in child.parents]
        return self._empty()

    def _drop(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        kind, name = ts[1].word, ts[-1].text.strip('"`')
        if kind in ("INDEX", "GROUP"):
            self.indexes.pop(name, None)
            return self._empty()
        if kind == "SEQUENCE":
            name = next(t.text for t in ts[2:] if t.word not in ("IF", "EXISTS")).split(".")[-1]
            self.sequences.pop(name.lower(), None)
            return self._empty()
        if kind == "VIEW":
            self.views.pop(name.lower(), None)
            self.spark.catalog.dropTempView(name)
            return self._empty()
        if kind == "TABLE":
            self.definitions.pop(name.lower(), None)
        return None

    def _truncate(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        name = ts[-1].text.strip('"`')
        self._replace(name, self.spark.table(name).limit(0))
        return self._empty()

    def _keep(self, name: str, df: DataFrame) -> None:
        df.write.format("parquet").saveAsTable(name)

    def _replace(self, name: str, df: DataFrame) -> None:
        """Write a table's new rows beside the old ones, then swap; the old ones go last, so the rows are never without a table."""
        mark = uuid.uuid4().hex[:8]
        self._keep(f"{name}_new_{mark}", df)
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{mark}")
        self.spark.sql(f"ALTER TABLE {name}_new_{mark} RENAME TO {name}")
        self.spark.sql(f"DROP TABLE {name}_old_{mark}")

    def _alter(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        words = [t.word for t in ts]
        name = ts[2].text.strip('"`')
        bare = lambda t: t.text.strip('"`')
        table = self.spark.table(name) if words[1] == "TABLE" else None
        if table is None or "GROUPING" in words or "CONSTRAINT" in words or "KEY" in words:
            return self._empty()
        if words[3] == "RENAME" and words[4] == "COLUMN":
            self._replace(name, table.withColumnRenamed(bare(ts[5]), bare(ts[7])))
        elif words[3] == "RENAME":
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {bare(ts[-1])}")
        elif words[3] == "DROP":
            self._replace(name, table.drop(bare(ts[-1])))
        elif words[3] == "ADD":
            at = 5 if words[4] == "COLUMN" else 4
            rest = ts[at + 1 :]
            default = next((i for i, t in enumerate(rest) if t.word == "DEFAULT"), None)
            kind = dialect.column_type(rest[:default])
            value = F.lit(None) if default is None else F.expr(dialect.to_spark(" ".join(t.text for t in rest[default + 1 :])))
            self._replace(name, table.withColumn(bare(ts[at]), value.cast(kind)))
        elif words[3] == "ALTER":
            at = 5 if words[4] == "COLUMN" else 4
            kind = next((i for i, w in enumerate(words) if w == "TYPE"), None)
            if kind is not None:
                self._replace(name, table.withColumn(bare(ts[at]), F.col(bare(ts[at])).cast(dialect.column_type(ts[kind + 1 :]))))
        return self._empty()

    # rows

    def _returning(self, ts: list[Token]) -> tuple[list[Token], str | None]:
        depth = 0
        for i, t in enumerate(ts):
            depth += (t.text == "(") - (t.text == ")")
            if t.word == "RETURNING" and not depth:
                return ts[:i], " ".join(x.text for x in ts[i + 1 :])
        return ts, None

    def _answer(self, rows: DataFrame, returning: str | None, count: int | None = None) -> DataFrame:
        if returning is None:
            return self.spark.createDataFrame([(rows.count() if count is None else count,)], "n long")
        view = f"rows_{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(view)
        return self._run(f"SELECT {returning} FROM {view}", ())

    def _insert(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        """Columns that are left out, or given as DEFAULT, get their defaults; numbered ones the next value for each row."""
        ts, returning = self._returning(ts)
        name, at = ts[2].text.strip('"`'), 3
        table = self.spark.table(name)
        own = self.definitions.get(name.lower())
        defaults, identity = (own.defaults, own.identity) if own else ({}, {})
        columns = None
        if ts[at].text == "(" and ts[at + 1].word not in ("SELECT", "VALUES", "WITH"):
            end = closing(ts, at)
            columns = [t.text.strip('"`') for t in ts[at + 1 : end] if t.text != ","]
            at = end + 1
        if ts[at].word == "DEFAULT":  # DEFAULT VALUES
            columns, rows = [], self.spark.range(1).select()
        elif ts[at].word == "VALUES":
            given = [split(row[1:-1], ",") for row in split(ts[at + 1 :], ",")]
            columns = columns or table.columns[: len(given[0])]
            value = lambda c, v: defaults.get(c.lower(), "NULL") if [t.word for t in v] == ["DEFAULT"] else " ".join(t.text for t in v)
            written = ", ".join(f"({', '.join(value(c, v) for c, v in zip(columns, row, strict=True))})" for row in given)
            rows = self._run(f"SELECT * FROM (VALUES {written}) AS v", parameters).toDF(*columns)
        else:
            rows = self._run(" ".join(t.text for t in ts[at:]), parameters)
            columns = columns or table.columns[: len(rows.columns)]
            rows = rows.toDF(*columns)
        there = {c.lower(): c for c in columns}
        other = lambda c: F.expr(dialect.to_spark(self._numbers(defaults[c.lower()]))) if c.lower() in defaults else F.lit(None)
        with lenient(self.spark):
            rows = rows.select(*[(F.col(there[c.lower()]) if c.lower() in there else other(c)).cast(k).alias(c) for c, k in table.dtypes])
        kinds = dict(table.dtypes)
        for c in table.columns:
            if c.lower() in identity:
                kept = self._kept(rows.withColumn("row_no", F.monotonically_increasing_id()), "identity")
                new = self.sequences[f"{name}/{c}".lower()].number(kept.where(F.col(c).isNull()), "row_no", c)
                rows = kept.where(F.col(c).isNotNull()).unionByName(new.withColumn(c, F.col(c).cast(kinds[c]))).drop("row_no")
        if returning is not None or name in [t.text.strip('"`') for t in ts[at:]]:  # read once: what is returned is what was written
            rows = self._kept(rows, "inserted")
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").format("parquet").saveAsTable(name)
        return self._answer(rows, returning, seen.get["n"])

    def _update(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        ts, returning = self._returning(ts)
        words = [t.word for t in ts]
        name, put = ts[1].text.strip('"`'), words.index("SET")
        alias = ts[put - 1].text.strip('"`')
        depth, where, source = 0, len(ts), len(ts)
        for i, t in enumerate(ts):
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.word == "WHERE" and i > put:
                where = min(where, i)
            if not depth and t.word == "FROM" and i > put:
                source = min(source, i)
        condition = " ".join(t.text for t in ts[where + 1 :]) or "TRUE"
        values = {}
        for part in split(ts[put + 1 : min(where, source)], ","):
            eq = next(i for i, t in enumerate(part) if t.text == "=")
            values[part[eq - 1].text.strip('"`').lower()] = " ".join(t.text for t in part[eq + 1 :])
        table = self.spark.table(name)
        new = [f"CAST({values[c.lower()]} AS {k}) AS `new_{c}`" if c.lower() in values else f"{alias}.`{c}` AS `new_{c}`" for c, k in table.dtypes]
        if source < len(ts):
            other = " ".join(t.text for t in ts[source + 1 : where])
            rowed, key = table.withColumn("_row", F.monotonically_increasing_id()), f"{name}_old_{uuid.uuid4().hex[:8]}"
            self._keep(key, rowed)  # numbers must not change between the two reads
            self.scratch.append(key)
            hits = self._run(f"SELECT {alias}._row AS _hit, {', '.join(new)} FROM {key} AS {alias}, {other} WHERE {condition}", parameters)
            hits = hits.groupBy("_hit").agg(F.min(F.struct(*[f"new_{c}" for c in table.columns])).alias("_new")).select("_hit", "_new.*")  # of several matches always the same
            all_ = self.spark.table(key).join(hits, F.col("_row") == F.col("_hit"), "left").withColumn("_is", F.col("_hit").isNotNull())
        else:
            all_ = self._run(f"SELECT {alias}.*, {', '.join(new)}, coalesce({condition}, FALSE) AS _is FROM {name} AS {alias}", parameters)
        done = all_.select("_is", *[F.when(F.col("_is"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in table.columns])
        return self._swap(name, done, table.columns, returning)

    def _delete(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        ts, returning = self._returning(ts)
        words = [t.word for t in ts]
        name = ts[2].text.strip('"`')
        where = words.index("WHERE") if "WHERE" in words else len(ts)
        alias = ts[where - 1].text.strip('"`')
        condition = " ".join(t.text for t in ts[where + 1 :]) or "TRUE"
        done = self._run(f"SELECT {alias}.*, coalesce({condition}, FALSE) AS _is FROM {name} AS {alias}", parameters)
        return self._swap(name, done, self.spark.table(name).columns, returning, drop=True)

    def _swap(self, name: str, done: DataFrame, columns: list[str], returning: str | None, drop: bool = False) -> DataFrame:
        """Keep the judged rows as a table of their own, put its rows in the table's place, and return those that are hit."""
        rows = self._kept(done, "judged")
        self._replace(name, (rows.where(~F.col("_is")) if drop else rows).select(*columns))
        return self._answer(rows.where("_is").select(*columns), returning)

    # statements and cursors by name

    def _prepare(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        inner = tokens(statement)
        skip = next(i for i, t in enumerate(inner) if t.word == "AS")
        self.prepared[ts[1].text.lower()] = text(inner[skip + 1 :])
        return self._empty()

    def _execute(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        inner = self.prepared[ts[1].text.lower()]
        given = list(parameters)
        if len(ts) > 2 and ts[2].text == "(":
            end = closing(ts, 2)
            if end > 3:
                given = list(self._run("SELECT " + " ".join(t.text for t in ts[3:end]), ()).first())
        return self._executed(inner, given)

    def _deallocate(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        del self.prepared[ts[-1].text.lower()]
        return self._empty()

    def _declare(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        inner = tokens(statement)
        at = next(i for i, t in enumerate(inner) if t.word == "FOR")
        self.cursors[ts[1].text.lower()] = self.sql(text(inner[at + 1 :]), parameters), None
        return self._empty()

    def _fetch(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        """FETCH [NEXT | n | ALL] FROM name. Rows come from the tasks one partition at a time; all of them stay where they are."""
        name, words = ts[-1].text.lower(), [t.word or t.text for t in ts[1:]]
        df, cursor = self.cursors[name]
        if cursor is None:
            self.cursors[name] = df, (cursor := iter(()) if words[0] == "ALL" else df.toLocalIterator())
            if words[0] == "ALL":
                return df
        most = None if words[0] == "ALL" else int(words[0]) if words[0].isdigit() else 1
        rows = []
        while most is None or len(rows) < most:
            row = next(cursor, None)
            if row is None:
                break
            rows.append(row)
        return self.spark.createDataFrame(rows, df.schema)

    def _close(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        del self.cursors[ts[-1].text.lower()]
        return self._empty()

    def _call(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        given = list(parameters)
        if len(ts) > 4:
            given = list(self._run("SELECT " + " ".join(t.text for t in ts[3 : closing(ts, 2)]), parameters).first())
        done = self.procedures[ts[1].text.lower()](self.spark, *given)
        return self.spark.createDataFrame([tuple(done.values())], [*done]) if isinstance(done, dict) else done

    def _copy(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        """``COPY table [(columns)] FROM 'path' ...`` and ``COPY table | (query) TO 'path' ...`` with CSV options."""
        depth, way = 0, 0
        for i, t in enumerate(ts):
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.word in ("FROM", "TO") and not way:
                way = i
        words = [t.word for t in ts]
        given = {k: ts[words.index(w, way) + 1].text.strip("'") for k, w in (("delimiter", "DELIMITER"), ("quote", "QUOTE"), ("escape", "ESCAPE"), ("null", "NULL"), ("encoding", "ENCODING")) if w in words[way:]}
        header, path = "HEADER" in words[way:], ts[way + 1].text.strip("'")
        if words[way] == "TO":
            inside = " ".join(t.text for t in ts[1:way])
            df = self._run(inside[1:-1] if ts[1].text == "(" else f"SELECT * FROM {inside}", parameters)
            files.write_csv(df, path, header=header, **given)
            return self._answer(df, None)
        table = self.spark.table(ts[1].text.strip('"`'))
        columns = [t.text.strip('"`') for t in ts[3 : way - 1] if t.text != ","] or table.columns
        kinds = dict(table.dtypes)
        rows = files.read_csv(self.spark, path, ", ".join(f"`{c}` {kinds[c]}" for c in columns), header=header, **given)
        rows = rows.select(*[(F.col(c) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in table.dtypes])
        rows.write.mode("append").format("parquet").saveAsTable(ts[1].text.strip('"`'))
        return self._answer(rows, None)

    def _set(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        if len(ts) < 4 or ts[2].text not in ("=",) and ts[2].word != "TO":
            return None
        self.settings[ts[1].text.lower()] = ts[3].text.strip("'")
        return self._empty()

    def _show(self, statement: str, ts: list[Token], parameters) -> DataFrame | None:
        name = ts[1].text.lower()
        value = self.settings.get(name, self.spark.conf.get(name, None) if len(ts) == 2 else None)
        return None if value is None else self.spark.createDataFrame([(value,)], f"`{name}` string")

    def _begin(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        return self._empty()

    _commit = _begin

    def _rollback(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        raise NotImplementedError("there are no transactions: every statement is final")

    def _explain(self, statement: str, ts: list[Token], parameters) -> DataFrame:
        inner = tokens(statement)
        at = next(i for i, t in enumerate(inner) if t.word in ("SELECT", "WITH", "VALUES"))
        plan = self.explain(text(inner[at:]))
        return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "operators string")

    # functions and procedures

    def function(self, name: str, f: Callable, result: str, deterministic: bool = True, vectorized: bool = False) -> None:
        """A scalar function for SQL: of one row's values, or of whole Arrow batches."""
        own = F.pandas_udf(f, result) if vectorized else F.udf(f, result, useArrow=True)
        self.functions[name.lower()] = (result, deterministic)
        self.spark.udf.register(name, own if deterministic else own.asNondeterministic())

    def procedure(self, name: str, f: Callable[..., DataFrame]) -> None:
        """A routine for CALL: takes the session and values, and returns a frame, or a dictionary of its OUT parameters for one row."""
        self.procedures[name.lower()] = f

    # groups

    def _parent(self, child: str, parent: str | None = None) -> tuple[str, groups.Edge]:
        for to, own, its, _ in self.definitions[child.lower()].parents:
            if parent is None or to.lower() == parent.lower():
                return to, groups.Edge(its[0], own[0])
        raise KeyError(f"{child} has no parent {parent or ''}")

    def orphans(self, child: str, parent: str | None = None) -> DataFrame:
        """Rows whose foreign key has no parent."""
        to, edge = self._parent(child, parent)
        return groups.inconsistent(self.spark.table(child), self.spark.table(to), edge)

    def group(self, root: str) -> groups.Node:
        """The tree of tables below ``root``, by their grouping keys. A key of the same name as its parent's is renamed inside."""

        def node(name: str, edge: groups.Edge | None) -> groups.Node:
            rows = self.spark.table(name)
            columns = rows.columns
            below = []
            for child in self.definitions.values():
                for to, own, its, grouped in child.parents:
                    if grouped and to.lower() == name.lower():
                        below.append(node(child.name, groups.Edge(its[0], f"_up_{own[0]}")))
            if edge is not None:
                rows = rows.withColumn(edge.child_key, F.col(edge.child_key.removeprefix("_up_")))
            return groups.Node(name, rows, columns, edge, tuple(below))

        return node(root, None)

    def dump(self, root: str, depth: int | None = None) -> DataFrame:
        """A group as JSON, one text for each row of its root."""
        return groups.dump(self.group(root), depth)

    def entity(self, root: str, key: str, depth: int | None = None) -> DataFrame:
        """The JSON of one root row by its primary key, as ``GET /entity/table/key`` would give it."""
        node = self.group(root)
        own = self.definitions[root.lower()].key[0]
        return groups.dump(groups.Node(node.name, node.rows.where(F.col(own).cast("string") == str(key)), node.columns, None, node.children), depth)

    def dump_script(self, root: str) -> DataFrame:
        """A group as INSERT statements, ``(level, statement)``: a table's rows after those of its parent's level."""

        def written(c: str, kind: str) -> Column:
            value = F.col(c).cast("string")
            plain = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")
            return F.coalesce(value if plain else F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))

        def lines(node: groups.Node, level: int) -> DataFrame:
            kinds = dict(node.rows.dtypes)
            values = F.concat_ws(", ", *[written(c, kinds[c]) for c in node.columns])
            out = node.rows.select(F.lit(level).alias("level"), F.concat(F.lit(f'INSERT INTO "{node.name}" VALUES('), values, F.lit(");")).alias("statement"))
            for child in node.children:
                out = out.union(lines(child, level + 1))
            return out

        return lines(self.group(root), 0)

    def delete_entity(self, root: str, key: str) -> DataFrame:
        """Delete a root row by its primary key, with all rows below it; returns how many rows went from each table."""
        node, own = self.group(root), self.definitions[root.lower()].key[0]
        found = groups.select_tree(node, F.col(own).cast("string") == str(key))
        gone, counts = {}, []

        def visit(node: groups.Node, parent: str | None) -> None:
            gone[node.name] = self._kept(found[node.name], "entity")
            counts.append((node.name, gone[node.name].count()))
            for child in node.children:
                visit(child, node.name)

        def drop(node: groups.Node, parent: groups.Node | None) -> None:
            for child in node.children:
                drop(child, node)
            if parent is None:
                rest = node.rows.where(~F.coalesce(F.col(own).cast("string") == str(key), F.lit(False)))
            else:
                ups = gone[parent.name].select(F.col(node.edge.parent_key).alias("gone_key")).distinct()
                rest = node.rows.join(ups, F.col(node.edge.child_key) == F.col("gone_key"), "left_anti")
            self._replace(node.name, rest.select(*node.columns))

        visit(node, None)
        drop(node, None)
        return self.spark.createDataFrame(counts, "table_name string, n long")

    def update_entity(self, root: str, key: str, body: str) -> DataFrame:
        """Put a nested JSON text in the place of a root row and all below it; returns the root's key."""
        self.delete_entity(root, key)
        return self.insert_entity(root, body)

    def insert_entity(self, root: str, body: str) -> DataFrame:
        """A nested JSON text as rows of the group's tables; returns the root's key."""

        def put(node: groups.Node, value: dict) -> None:
            names = [c for c in node.columns if c in value]
            row = self.spark.createDataFrame([tuple(json.dumps(value[c]) if isinstance(value[c], (dict, list)) else value[c] for c in names)], [*names])
            row.createOrReplaceTempView("entity_row")
            self.sql(f"INSERT INTO {node.name} ({', '.join(names)}) SELECT * FROM entity_row")
            for child in node.children:
                for x in value.get(child.name, []):
                    put(child, {child.edge.child_key.removeprefix("_up_"): value[child.edge.parent_key]} | x)

        value = json.loads(body)
        put(self.group(root), value)
        own = self.definitions[root.lower()].key[0]
        return self.spark.createDataFrame([(value[own],)], [own])
