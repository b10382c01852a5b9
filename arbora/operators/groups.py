"""Table groups: a parent and its children, flattened, multiplied across branches, or nested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """A child's foreign key to its parent. Both may have the same name."""

    parent_key: str
    child_key: str


def _apart(df: DataFrame, taken: Sequence[str], prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with a prefix before names that are taken, and every column's name now."""
    names = {c: c for c in df.columns}
    for c in df.columns:
        while names[c] in taken or (names[c] != c and names[c] in df.columns):
            names[c] = prefix + names[c]
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def _joined(left: DataFrame, left_key: str, right: DataFrame, right_key: str, how: str, prefix: str) -> DataFrame:
    right, names = _apart(right, left.columns, prefix)
    return left.join(right, F.col(left_key) == F.col(names[right_key]), how)


def flatten(parent: DataFrame, child: DataFrame, edge: Edge, how: str = "inner", keep_parent: bool = False, keep_child: bool = False) -> DataFrame:
    """Parent and child rows side by side; kept rows follow as rows of their own, with nulls for the other side.

    A child's column whose name the parent has too is named ``child_`` and its name.
    """
    child, names = _apart(child, parent.columns, "child_")
    out = parent.join(child, F.col(edge.parent_key) == F.col(names[edge.child_key]), how)
    for keep, df in ((keep_parent, parent), (keep_child, child)):
        if keep:
            out = out.unionByName(df, allowMissingColumns=True)
    return out


def ancestors(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """Each child row with its parent; a child without one stays. A name that both have gets ``parent_`` before the parent's."""
    return _joined(child, edge.child_key, parent, edge.parent_key, "left", "parent_")


def branch(parent: DataFrame, child: DataFrame, edge: Edge) -> DataFrame:
    """The child rows below the given parents."""
    return _joined(child, edge.child_key, parent.select(edge.parent_key), edge.parent_key, "left_semi", "parent_")


def product(parent: DataFrame, first: DataFrame, first_edge: Edge, second: DataFrame, second_edge: Edge) -> DataFrame:
    """For each parent every pair of rows of two branches; names that are taken get ``first_`` or ``second_`` before them."""
    out = _joined(parent, first_edge.parent_key, first, first_edge.child_key, "inner", "first_")
    return _joined(out, second_edge.parent_key, second, second_edge.child_key, "inner", "second_")


def product_counts(
    parent: DataFrame, first: DataFrame, first_edge: Edge, second: DataFrame, second_edge: Edge, by: Sequence[str], into: str = "n",
    first_distinct: Mapping[str, str] | None = None, second_distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """Of :func:`product`, by columns of the parent: its rows, and distinct values of columns of either branch.

    No pair is made: each row of the first branch counts as many times as its parent has rows in the second, and values of the
    second are taken below parents that have rows in the first. ``*_distinct`` are names of results and the columns they count.
    """
    parents = parent.select(F.col(first_edge.parent_key).alias("_first"), F.col(second_edge.parent_key).alias("_second"), *by)

    def below(df: DataFrame, edge: Edge, key: str, other: DataFrame, other_edge: Edge, other_key: str, columns: Mapping[str, str] | None) -> DataFrame:
        times = other.groupBy(F.col(other_edge.child_key).alias("_other")).agg(F.count("*").alias("_times"))
        rows = df.select(F.col(edge.child_key).alias("_up"), *[F.col(c).alias(n) for n, c in (columns or {}).items()])
        return rows.join(parents.join(times, F.col(other_key) == F.col("_other")), F.col("_up") == F.col(key)).groupBy(*by)

    count = [F.countDistinct(n).alias(n) for n in first_distinct or {}]
    out = below(first, first_edge, "_first", second, second_edge, "_second", first_distinct).agg(F.coalesce(F.sum("_times"), F.lit(0)).alias(into), *count)
    if second_distinct:
        more = below(second, second_edge, "_second", first, first_edge, "_first", second_distinct).agg(*[F.countDistinct(n).alias(n) for n in second_distinct])
        names = [into, *(first_distinct or {}), *second_distinct]
        out = out.unionByName(more, allowMissingColumns=True).groupBy(*by).agg(*[F.max(n).alias(n) for n in names])
    return out


def nest(parent: DataFrame, child: DataFrame, edge: Edge, columns: Sequence[str | Column], into: str) -> DataFrame:
    """Parents with their children as a sorted array of structs; an empty array where there are none."""
    rows = child.groupBy(F.col(edge.child_key).alias("_up")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(into))
    out = parent.join(rows, F.col(edge.parent_key) == F.col("_up"), "left").drop("_up")
    return out.withColumn(into, F.coalesce(into, F.array()))


def select(parents: DataFrame, where: Column, children: Sequence[tuple[DataFrame, Edge]]) -> tuple[DataFrame, list[DataFrame]]:
    """Parents that satisfy a condition, and of each child table the rows below them."""
    kept = parents.where(F.coalesce(where, F.lit(False)))
    return kept, [branch(kept, child, edge) for child, edge in children]


def select_tree(root: Node, where: Column) -> dict[str, DataFrame]:
    """Of a whole group the root rows that satisfy a condition and all rows below them, by table, at any depth."""
    out = {root.name: root.rows.where(F.coalesce(where, F.lit(False)))}

    def below(node: Node) -> None:
        for child in node.children:
            out[child.name] = branch(out[node.name], child.rows, child.edge)
            below(child)

    below(root)
    return out


def hkey_union(*keys: DataFrame) -> DataFrame:
    """The keys that any of the frames holds, once each; by position, as the first frame names them."""
    out = keys[0]
    for more in keys[1:]:
        out = out.union(more)
    return out.distinct()


@dataclass(frozen=True)
class Node:
    """A table of a group, with its children: name, rows, columns to show, and the edge to its parent."""

    name: str
    rows: DataFrame
    columns: Sequence[str]
    edge: Edge | None = None
    children: tuple[Node, ...] = ()


def nested(root: Node, depth: int | None = None, empty: bool = True) -> DataFrame:
    """The group as one row for each root row, with an array of structs for each child table, down to ``depth`` levels.

    Without ``empty`` a parent that has no rows of a child gets NULL, which JSON leaves out.
    """
    keys = [n.edge.parent_key for n in root.children] if depth != 0 else []
    out = root.rows.select(*dict.fromkeys([*root.columns, *([root.edge.child_key] if root.edge else []), *keys]))
    for n in root.children if depth != 0 else ():
        below = nested(n, None if depth is None else depth - 1, empty)
        inside = [*n.columns, *([c.name for c in n.children] if depth is None or depth > 1 else [])]
        rows = below.groupBy(F.col(n.edge.child_key).alias("_up")).agg(F.array_sort(F.collect_list(F.struct(*inside))).alias(n.name))
        out = out.join(rows, F.col(n.edge.parent_key) == F.col("_up"), "left").drop("_up")
        if empty:
            out = out.withColumn(n.name, F.coalesce(n.name, F.array()))
    names = [c.name for c in root.children] if depth != 0 else []
    return out.select(*dict.fromkeys([*root.columns, *([root.edge.child_key] if root.edge else []), *names]))


def dump(root: Node, depth: int | None = None) -> DataFrame:
    """One JSON text for each root row, with its branch below; tables without rows are left out."""
    return nested(root, depth, empty=False).select(F.to_json(F.struct("*")).alias("json"))


def inconsistent(child: DataFrame, parent: DataFrame, edge: Edge) -> DataFrame:
    """Child rows whose key has no parent. A NULL key is consistent."""
    return _joined(child.where(F.col(edge.child_key).isNotNull()), edge.child_key, parent.select(edge.parent_key), edge.parent_key, "left_anti", "parent_")
