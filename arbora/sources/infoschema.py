"""The catalog as frames under the names of the information schema; no table is read for them.

Columns that only a server of its own has (character sets, storage names, index trees) are left out.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from ..plans.engine import Engine

NAMES = (
    "schemata", "tables", "columns", "table_constraints", "referential_constraints", "grouping_constraints", "key_column_usage", "sequences", "views", "routines", "parameters", "types",
    "indexes", "index_columns", "view_table_usage", "view_column_usage", "jars", "routine_jar_usage", "script_engines", "script_engine_names", "type_bundles", "type_attributes",
    "server_servers", "server_sessions", "server_statistics_summary", "server_users",
    "server_instance_summary", "server_parameters", "server_prepared_statements", "server_cursors", "server_memory_pools", "server_garbage_collectors",
)
_NUMERIC = {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "float": (24, None), "double": (53, None)}


def _schema(engine: Engine) -> str:
    return engine.spark.catalog.currentDatabase()


def _frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def schemata(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [(d.name,) for d in engine.spark.catalog.listDatabases()], "schema_name string")


def tables(engine: Engine) -> DataFrame:
    kinds = {"MANAGED": "TABLE", "EXTERNAL": "TABLE", "TEMPORARY": "VIEW", "VIEW": "VIEW"}
    rows = [((t.namespace or [_schema(engine)])[0], t.name, kinds.get(t.tableType, t.tableType), "NO" if kinds.get(t.tableType) == "VIEW" else "YES") for t in engine.spark.catalog.listTables()]
    return _frame(engine.spark, rows, "table_schema string, table_name string, table_type string, is_insertable_into string")


def columns(engine: Engine, names: list[str] | None = None) -> DataFrame:
    rows = []
    for t in names or [t.name for t in engine.spark.catalog.listTables()]:
        for i, c in enumerate(engine.spark.catalog.listColumns(t), 1):
            size = re.match(r"decimal\((\d+),(\d+)\)", c.dataType)
            precision, scale = (int(size[1]), int(size[2])) if size else _NUMERIC.get(c.dataType, (None, None))
            rows.append((_schema(engine), t, c.name, i, "YES" if c.nullable else "NO", c.dataType.upper(), precision, 10 if precision else None, scale))
    return _frame(engine.spark, rows, "table_schema string, table_name string, column_name string, ordinal_position long, is_nullable string, data_type string, numeric_precision long, numeric_precision_radix long, numeric_scale long")


def _constraints(engine: Engine):
    for d in engine.definitions.values():
        if d.key:
            yield d.name, f"{d.name}.PRIMARY", "PRIMARY KEY", d.key, None, []
        for i, (to, own, its, grouped) in enumerate(d.parents):
            yield d.name, f"{d.name}.{'__grouping' if grouped else '__fk'}_{i + 1}", "GROUPING" if grouped else "FOREIGN KEY", own, to, its


def table_constraints(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), name, _schema(engine), table, kind, "NO", "NO", "NO") for table, name, kind, *_ in _constraints(engine)]
    return _frame(engine.spark, rows, "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string, is_deferrable string, initially_deferred string, enforced string")


def referential_constraints(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), name, _schema(engine), f"{to}.PRIMARY", "SIMPLE", "NO ACTION", "NO ACTION") for _, name, kind, _, to, _ in _constraints(engine) if kind == "FOREIGN KEY"]
    return _frame(engine.spark, rows, "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string, match_option string, update_rule string, delete_rule string")


def grouping_constraints(engine: Engine) -> DataFrame:
    """Every table with its place in its group."""
    up = {d.name.lower(): next(((to, i) for i, (to, _, _, grouped) in enumerate(d.parents) if grouped), None) for d in engine.definitions.values()}
    rows = []
    for d in engine.definitions.values():
        path, at = [d.name], up.get(d.name.lower())
        while at is not None:
            path.insert(0, at[0])
            at = up.get(at[0].lower())
        own = up.get(d.name.lower())
        rows.append((_schema(engine), path[0], _schema(engine), d.name, "/".join(path), len(path) - 1, f"{d.name}.__grouping_{own[1] + 1}" if own else None, f"{own[0]}.PRIMARY" if own else None))
    return _frame(engine.spark, rows, "root_table_schema string, root_table_name string, constraint_schema string, constraint_table_name string, path string, depth long, constraint_name string, unique_constraint_name string")


def key_column_usage(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), name, _schema(engine), table, c, i, i if to else None) for table, name, _, own, to, _ in _constraints(engine) for i, c in enumerate(own)]
    return _frame(engine.spark, rows, "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position long, position_in_unique_constraint long")


def sequences(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), n, "BIGINT", s.start, 1 if s.low is None else s.low, 2**63 - 1 if s.high is None else s.high, s.step, "YES" if s.cycle else "NO") for n, s in engine.sequences.items()]
    return _frame(engine.spark, rows, "sequence_schema string, sequence_name string, data_type string, start_value long, minimum_value long, maximum_value long, increment long, cycle_option string")


def views(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), t.name, engine.views.get(t.name.lower()), "NO", "NO") for t in engine.spark.catalog.listTables() if t.tableType in ("VIEW", "TEMPORARY")]
    return _frame(engine.spark, rows, "table_schema string, table_name string, view_definition string, is_updatable string, is_insertable_into string")


def routines(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), n, "PROCEDURE", "PYTHON", "NO") for n in engine.procedures] + [(_schema(engine), n, "FUNCTION", "PYTHON", "YES" if d else "NO") for n, (_, d) in engine.functions.items()]
    return _frame(engine.spark, rows, "routine_schema string, routine_name string, routine_type string, language string, is_deterministic string")


def parameters(engine: Engine) -> DataFrame:
    """The results of functions; Python functions do not declare their arguments' types."""
    rows = [(_schema(engine), n, None, 0, kind.upper(), "OUT", "YES") for n, (kind, _) in engine.functions.items()]
    return _frame(engine.spark, rows, "specific_schema string, specific_name string, parameter_name string, ordinal_position long, data_type string, parameter_mode string, is_result string")


def types(engine: Engine) -> DataFrame:
    from ..plans.dialect import TYPES

    return _frame(engine.spark, sorted((n.upper(), k.upper()) for n, k in TYPES.items()), "type_name string, spark_type string")


def server_instance_summary(engine: Engine) -> DataFrame:
    spark = engine.spark
    return _frame(spark, [(spark.sparkContext.appName, spark.version, spark.conf.get("spark.driver.host", "localhost"), spark.sparkContext.applicationId)], "server_name string, server_version string, server_host string, server_id string")


def server_parameters(engine: Engine) -> DataFrame:
    hidden = re.compile("password|secret|token|credential", re.IGNORECASE)
    rows = [(k, "*****" if hidden.search(k) else v) for k, v in sorted(engine.spark.sparkContext.getConf().getAll())] + sorted(engine.settings.items())
    return _frame(engine.spark, rows, "parameter_name string, current_value string")


def server_prepared_statements(engine: Engine) -> DataFrame:
    return _frame(engine.spark, sorted(engine.prepared.items()), "prepared_name string, statement string")


def server_cursors(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [(n,) for n in sorted(engine.cursors)], "cursor_name string")


def _beans(engine: Engine):
    return engine.spark.sparkContext._jvm.java.lang.management.ManagementFactory


def server_memory_pools(engine: Engine) -> DataFrame:
    rows = [(p.getName(), str(p.getType()), p.getUsage().getUsed(), p.getUsage().getMax(), p.getPeakUsage().getUsed()) for p in _beans(engine).getMemoryPoolMXBeans()]
    return _frame(engine.spark, rows, "name string, type string, used_bytes long, max_bytes long, peak_bytes long")


def server_garbage_collectors(engine: Engine) -> DataFrame:
    rows = [(g.getName(), g.getCollectionCount(), g.getCollectionTime()) for g in _beans(engine).getGarbageCollectorMXBeans()]
    return _frame(engine.spark, rows, "name string, total_count long, total_milliseconds long")


def _indexes(engine: Engine):
    """Table, name, whether unique, kind and columns: primary keys, and what CREATE INDEX has named."""
    for d in engine.definitions.values():
        if d.key:
            yield d.name, "PRIMARY", "PRIMARY", [(c, "YES") for c in d.key]
    for name, (table, unique, columns) in engine.indexes.items():
        yield table, name, "UNIQUE" if unique else "INDEX", columns


def indexes(engine: Engine) -> DataFrame:
    """Indexes are facts only; scans prune by file statistics."""
    rows = [(_schema(engine), table, name, f"{table}.PRIMARY" if kind == "PRIMARY" else None, i, kind, "NO" if kind == "INDEX" else "YES") for i, (table, name, kind, _) in enumerate(_indexes(engine), 1)]
    return _frame(engine.spark, rows, "table_schema string, table_name string, index_name string, constraint_name string, index_id long, index_type string, is_unique string")


def index_columns(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), table, name, c, i, up) for table, name, _, own in _indexes(engine) for i, (c, up) in enumerate(own)]
    return _frame(engine.spark, rows, "index_table_schema string, index_table_name string, index_name string, column_name string, ordinal_position long, is_ascending string")


def _used_by_views(engine: Engine):
    from ..plans.dialect import tokens

    there = {t.name.lower() for t in engine.spark.catalog.listTables()}
    for view, text in engine.views.items():
        words = {t.text.strip('"`').lower() for t in tokens(text)}
        for table in sorted(words & there - {view}):
            yield view, table, words


def view_table_usage(engine: Engine) -> DataFrame:
    rows = [(_schema(engine), view, _schema(engine), table) for view, table, _ in _used_by_views(engine)]
    return _frame(engine.spark, rows, "view_schema string, view_name string, table_schema string, table_name string")


def view_column_usage(engine: Engine) -> DataFrame:
    """Columns of a view's tables that its text names."""
    rows = [(_schema(engine), view, _schema(engine), table, c.name) for view, table, words in _used_by_views(engine) for c in engine.spark.catalog.listColumns(table) if c.name.lower() in words]
    return _frame(engine.spark, rows, "view_schema string, view_name string, table_schema string, table_name string, column_name string")


def jars(engine: Engine) -> DataFrame:
    """Jars that the session was given."""
    found = [x for x in (engine.spark.conf.get("spark.jars", "") or "").split(",") if x]
    return _frame(engine.spark, [(_schema(engine), x.rsplit("/", 1)[-1], x) for x in found], "jar_schema string, jar_name string, java_path string")


def routine_jar_usage(engine: Engine) -> DataFrame:
    """Empty: routines are SQL or Python."""
    return _frame(engine.spark, [], "specific_schema string, specific_name string, jar_schema string, jar_name string")


def script_engines(engine: Engine) -> DataFrame:
    import sys

    return _frame(engine.spark, [(1, "CPython", sys.version.split()[0], "Python"), (2, "Spark", engine.spark.version, "SQL")], "engine_id long, engine_name string, engine_version string, language_name string")


def script_engine_names(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [("python", 1), ("sql", 2)], "engine_name string, engine_id long")


def type_bundles(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [("arbora",)], "bundle_name string")


def type_attributes(engine: Engine) -> DataFrame:
    """What a type's name may be followed by."""
    rows = [(t, a) for t, more in (("DECIMAL", ("PRECISION", "SCALE")), ("NUMERIC", ("PRECISION", "SCALE")), ("CHAR", ("LENGTH", "COLLATION")), ("VARCHAR", ("LENGTH", "COLLATION"))) for a in more]
    return _frame(engine.spark, rows, "type_name string, attribute_name string")


def server_servers(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [("spark", engine.spark.sparkContext.master, engine.spark.sparkContext.startTime)], "server_type string, master string, start_milliseconds long")


def server_sessions(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [(id(engine), "spark", engine.last_statement, sum(engine.statistics.values()))], "session_id long, server_type string, last_query_executed string, query_count long")


def server_statistics_summary(engine: Engine) -> DataFrame:
    """Statements of this session by kind."""
    kinds = {"call_statement_count": ("CALL",), "ddl_statement_count": ("CREATE", "DROP", "ALTER", "RENAME", "TRUNCATE"), "dml_statement_count": ("INSERT", "UPDATE", "DELETE", "COPY"), "select_statement_count": ("SELECT", "VALUES", "WITH")}
    counts = {name: sum(engine.statistics[w] for w in words) for name, words in kinds.items()}
    whole = sum(engine.statistics.values())
    return _frame(engine.spark, [(whole, *counts.values(), whole - sum(counts.values()))], "query_count long, " + ", ".join(f"{n} long" for n in counts) + ", other_statement_count long")


def server_users(engine: Engine) -> DataFrame:
    return _frame(engine.spark, [(engine.spark.sparkContext.sparkUser(), sum(engine.statistics.values()))], "user_name string, statement_count long")


def frame(engine: Engine, name: str) -> DataFrame:
    if name not in NAMES:
        raise KeyError(f"information_schema has no {name}")
    return globals()[name](engine)
