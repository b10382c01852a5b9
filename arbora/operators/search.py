"""Full-text search by plain expressions; spatial search is in :mod:`arbora.functions.spatial`."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")


def _once(value: Column) -> Column:
    """Always the value, but not deterministic for Catalyst, which so evaluates it in its own step and not for every use."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def full_text(df: DataFrame, text: str, must: Sequence[str] = (), should: Sequence[str] = (), must_not: Sequence[str] = ()) -> DataFrame:
    """Rows whose text has every ``must`` term, no ``must_not`` term and, without ``must``, a ``should`` term.

    ``hits`` counts the terms found. The term array is built once for a row.
    """
    df = df.withColumn("_terms", _once(terms(F.col(text))))
    has = lambda t: F.coalesce(F.array_contains("_terms", t), F.lit(False))
    kept = [has(t) for t in must] + [~has(t) for t in must_not]
    if should and not must:
        kept.append(reduce(lambda a, b: a | b, map(has, should)))
    found = [has(t).cast("int") for t in [*must, *should]]
    df = df.withColumn("hits", reduce(lambda a, b: a + b, found) if found else F.lit(0))
    return (df.where(reduce(lambda a, b: a & b, kept)) if kept else df).drop("_terms")


#: A term of a query: sign, field, and a phrase or a word; or a bracket.
_TERM = re.compile(r"""([+\-!]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"()]+)|(\()|(\)))""")


@dataclass(frozen=True)
class Clause:
    """One word or phrase of a query, or clauses in brackets: ``must``, ``should`` or ``not``, in a field or in the default one."""

    role: str
    field: str | None
    words: tuple[str, ...]
    inside: tuple[Clause, ...] = ()


def parse(query: str) -> list[Clause]:
    """Clauses of ``+must -not should "a phrase" field:word (a b)``; AND and NOT between them are read as signs."""
    levels: list[list[Clause]] = [[]]
    opened: list[tuple[str, str | None]] = []
    after = ""

    def put(sign: str, field: str | None, words: tuple[str, ...], inside: tuple[Clause, ...] = ()) -> None:
        levels[-1].append(Clause({"+": "must", "-": "not", "!": "not"}.get(sign, "should"), field or None, words, inside))

    def close() -> None:
        inside = tuple(levels.pop())
        sign, field = opened.pop()
        if inside:
            put(sign, field, (), tuple(Clause(c.role, c.field or field, c.words, c.inside) for c in inside))

    for sign, field, phrase, word, begin, end in _TERM.findall(query):
        out = levels[-1]
        if word in ("AND", "&&"):
            if out and out[-1].role == "should":
                out[-1] = Clause("must", out[-1].field, out[-1].words, out[-1].inside)
            after = "+"
        elif word == "NOT":
            after = "-"
        elif word in ("OR", "||"):
            after = ""
        elif begin:
            opened.append((sign or after, field or None))
            levels.append([])
            after = ""
        elif end:
            if opened:
                close()
            after = ""
        elif words := tuple(re.findall(r"[^\W_]+", (phrase or word).lower())):
            put(sign or after, field, words)
            after = ""
    while opened:
        close()
    return levels[0]


def _searchable(field: str) -> str:
    """The field's terms with a space before, between and after them, as SQL."""
    return f"concat(' ', array_join(split(lower(regexp_replace({field}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' ')), ' '), ' '), ' ')"


def _holds(clauses: Sequence[Clause], found: Callable[[Clause], Column]) -> Column:
    """Every ``must``, no ``not``, and without ``must`` any ``should``; nothing holds without either."""

    def one(c: Clause) -> Column:
        return _holds(c.inside, found) if c.inside else found(c)

    musts, shoulds, nots = ([one(c) for c in clauses if c.role == r] for r in ("must", "should", "not"))
    parts = musts or ([reduce(lambda a, b: a | b, shoulds)] if shoulds else [F.lit(False)])
    return reduce(lambda a, b: a & b, [*parts, *(~n for n in nots)])


def _leaves(clauses: Sequence[Clause]) -> list[Clause]:
    return [x for c in clauses for x in (_leaves(c.inside) if c.inside else [c])]


def condition(query: str, field: str) -> str:
    """A query over one field as a condition of SQL; a NULL field holds nothing."""

    def written(clauses: Sequence[Clause]) -> str:
        one = lambda c: written(c.inside) if c.inside else f"contains({_searchable(c.field or field)}, ' {' '.join(c.words)} ')"
        musts, shoulds, nots = ([one(c) for c in clauses if c.role == r] for r in ("must", "should", "not"))
        parts = musts or ([f"({' OR '.join(shoulds)})"] if shoulds else ["FALSE"])
        return f"({' AND '.join([*parts, *(f'NOT {n}' for n in nots)])})"

    return f"coalesce({written(parse(query))}, FALSE)"


def full_text_search(df: DataFrame, query: str, field: str, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows that match a query, with ``hits``, the words and phrases wanted that a row has; the best ones, ties by a column, if there is a limit.

    Each field's terms are made once for a row.
    """
    clauses = parse(query)
    fields = {f: f"_terms{i}" for i, f in enumerate(dict.fromkeys(c.field or field for c in _leaves(clauses)))}
    out = df
    for f, name in fields.items():
        out = out.withColumn(name, _once(F.concat(F.lit(" "), F.array_join(terms(F.col(f)), " "), F.lit(" "))))
    has = lambda c: F.coalesce(F.contains(F.col(fields[c.field or field]), F.lit(f" {' '.join(c.words)} ")), F.lit(False))
    wanted = dict.fromkeys(c for top in clauses if top.role != "not" for c in _leaves([top]) if c.role != "not")
    counted = [has(c).cast("int") for c in wanted]
    out = out.withColumn("hits", reduce(lambda a, b: a + b, counted) if counted else F.lit(0)).where(_holds(clauses, has)).drop(*fields.values())
    return out if limit is None else out.orderBy(F.desc("hits"), *([tie] if tie else [])).limit(limit)
