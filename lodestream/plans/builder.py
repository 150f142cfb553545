"""A fluent query builder that works out the joins.

Tables named in the query are connected along declared foreign keys, whatever other tables that takes.  The result is SQL with bound
parameters that ``spark.sql`` runs; optimising it is Catalyst's business.  Sort orders name the place of nulls (last when ascending, first
when descending), so that every engine agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .graph import RelationGraph

_REFERENCE = re.compile(r"\b([a-zA-Z_]\w*)\s*\.\s*[a-zA-Z_]\w*\b")
_SUBQUERY = re.compile(r"\(\s*select\b", re.IGNORECASE)


def without_subqueries(text: str) -> str:
    """The text with every parenthesised SELECT taken out."""
    while (found := _SUBQUERY.search(text)) is not None:
        depth, end = 0, len(text)
        for at in range(found.start(), len(text)):
            depth += (text[at] == "(") - (text[at] == ")")
            if depth == 0:
                end = at + 1
                break
        text = text[: found.start()] + " " + text[end:]
    return text


def tables_in(text: str) -> list[str]:
    """Qualifiers of all ``table.column`` references outside subqueries, lower case, in order."""
    return [m.lower() for m in _REFERENCE.findall(without_subqueries(text))]


@dataclass
class _Leaf:
    text: str
    params: tuple = ()

    def tables(self) -> list[str]:
        return tables_in(self.text)

    def render(self, params: list) -> str:
        params += self.params
        return self.text


@dataclass
class _Subquery:
    """``prefix (query)``: membership or existence."""

    prefix: str
    query: QueryBuilder | str
    params: tuple = ()

    def tables(self) -> list[str]:
        return tables_in(self.prefix)

    def render(self, params: list) -> str:
        if isinstance(self.query, str):
            params += self.params
            return f"{self.prefix} ({self.query})"
        text = self.query.build(member=True)
        params += self.query.parameters
        return f"{self.prefix} ({text})"


@dataclass
class _Group:
    word: str
    parts: list = field(default_factory=list)

    def tables(self) -> list[str]:
        return [t for p in self.parts for t in p.tables()]

    def render(self, params: list, top: bool = False) -> str:
        texts = [t for p in self.parts if (t := p.render(params))]
        joined = f" {self.word} ".join(texts)
        return joined if top or len(texts) < 2 else f"({joined})"


@dataclass
class _Join:
    kind: str
    table: str
    name: str
    condition: str

    def render(self) -> str:
        return f"{self.kind} {self.table}{'' if self.name == self.table else ' ' + self.name} ON {self.condition}"


@dataclass
class _Explicit:
    kind: str
    from_name: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]
    alias: str | None


class QueryBuilder:
    def __init__(self, graph: RelationGraph, spark: SparkSession | None = None):
        self._graph, self._spark = graph, spark
        self._select: list[str] = []
        self._distinct = False
        self._aliases: dict[str, str] = {}
        self._where = _Group("AND")
        self._open: list[_Group] = [self._where]
        self._having: list[_Leaf] = []
        self._group: list[str] = []
        self._order: list[tuple[str, bool]] = []
        self._kinds: dict[str, str] = {}
        self._explicit: list[_Explicit] = []
        self._ctes: list[tuple[str, QueryBuilder | str, tuple]] = []
        self._unions: list[tuple[str, QueryBuilder]] = []
        self._limit: int | None = None
        self._parameters: list | None = None

    # --- projection

    def select(self, *items: str) -> QueryBuilder:
        self._select += items
        return self

    def distinct(self) -> QueryBuilder:
        self._distinct = True
        return self

    def _aggregate(self, function: str, column: str, alias: str | None) -> QueryBuilder:
        return self.select(f"{function}({column})" + (f" AS {alias}" if alias else ""))

    def select_count(self, column: str, alias: str | None = None) -> QueryBuilder:
        return self._aggregate("COUNT", column, alias)

    def select_sum(self, column: str, alias: str | None = None) -> QueryBuilder:
        return self._aggregate("SUM", column, alias)

    def select_avg(self, column: str, alias: str | None = None) -> QueryBuilder:
        return self._aggregate("AVG", column, alias)

    def select_min(self, column: str, alias: str | None = None) -> QueryBuilder:
        return self._aggregate("MIN", column, alias)

    def select_max(self, column: str, alias: str | None = None) -> QueryBuilder:
        return self._aggregate("MAX", column, alias)

    def alias(self, table: str, alias: str) -> QueryBuilder:
        """One alias per table, the last one given."""
        self._aliases[table.lower()] = alias.lower()
        return self

    def resolve_alias(self, name: str) -> str:
        name = name.lower()
        return next((t for t, a in self._aliases.items() if a == name), name)

    # --- predicates

    def where(self, condition: str, *params: Any) -> QueryBuilder:
        self._open[-1].parts.append(_Leaf(condition, params))
        return self

    def _start(self, word: str) -> QueryBuilder:
        group = _Group(word)
        self._open[-1].parts.append(group)
        self._open.append(group)
        return self

    def _end(self, name: str) -> QueryBuilder:
        if len(self._open) == 1:
            raise ValueError(f"{name} without a group to close")
        self._open.pop()
        return self

    def start_or(self) -> QueryBuilder:
        return self._start("OR")

    def end_or(self) -> QueryBuilder:
        return self._end("end_or")

    def start_and(self) -> QueryBuilder:
        return self._start("AND")

    def end_and(self) -> QueryBuilder:
        return self._end("end_and")

    def _sub(self, prefix: str, query: QueryBuilder | str, params: tuple) -> QueryBuilder:
        self._open[-1].parts.append(_Subquery(prefix, query, params))
        return self

    def where_in(self, column: str, query: QueryBuilder | str, *params: Any) -> QueryBuilder:
        return self._sub(f"{column} IN", query, params)

    def where_not_in(self, column: str, query: QueryBuilder | str, *params: Any) -> QueryBuilder:
        """Null-aware: one null in the subquery leaves no row."""
        return self._sub(f"{column} NOT IN", query, params)

    def where_exists(self, query: QueryBuilder | str, *params: Any) -> QueryBuilder:
        """A correlated subquery must be given as text: a builder joins every table that it names itself."""
        return self._sub("EXISTS", query, params)

    def where_not_exists(self, query: QueryBuilder | str, *params: Any) -> QueryBuilder:
        return self._sub("NOT EXISTS", query, params)

    def group_by(self, *items: str) -> QueryBuilder:
        self._group += items
        return self

    def having(self, condition: str, *params: Any) -> QueryBuilder:
        self._having.append(_Leaf(condition, params))
        return self

    # --- joins

    def _add_join(self, kind: str, from_table: str, from_columns, to_table: str, to_columns, alias: str | None) -> QueryBuilder:
        own = (from_columns,) if isinstance(from_columns, str) else tuple(from_columns)
        far = (to_columns,) if isinstance(to_columns, str) else tuple(to_columns)
        if not own or len(own) != len(far):
            raise ValueError(f"a join needs as many columns on either side: {own} and {far}")
        self._explicit.append(_Explicit(kind, from_table.lower(), own, self.resolve_alias(to_table), far, alias.lower() if alias else None))
        return self

    def join(self, from_table: str, from_columns: str | Sequence[str], to_table: str, to_columns: str | Sequence[str], alias: str | None = None) -> QueryBuilder:
        return self._add_join("JOIN", from_table, from_columns, to_table, to_columns, alias)

    def left_join(self, table: str, from_columns=None, to_table: str | None = None, to_columns=None, alias: str | None = None) -> QueryBuilder:
        """With a table alone: join it as a left join when inference brings it in (no effect on the root).  Else an explicit join."""
        if to_table is None:
            self._kinds[self.resolve_alias(table)] = "LEFT JOIN"
            return self
        return self._add_join("LEFT JOIN", table, from_columns, to_table, to_columns, alias)

    def right_join(self, table: str, from_columns=None, to_table: str | None = None, to_columns=None, alias: str | None = None) -> QueryBuilder:
        if to_table is None:
            self._kinds[self.resolve_alias(table)] = "RIGHT JOIN"
            return self
        return self._add_join("RIGHT JOIN", table, from_columns, to_table, to_columns, alias)

    # --- order, set operations, common tables

    def order_by(self, *items: str) -> QueryBuilder:
        self._order += [(i, True) for i in items]
        return self

    def order_by_desc(self, *items: str) -> QueryBuilder:
        self._order += [(i, False) for i in items]
        return self

    def limit(self, rows: int) -> QueryBuilder:
        """Applied when rows are fetched; it is not part of the text, so it is ignored in subqueries, unions and common tables."""
        self._limit = rows
        return self

    def with_(self, name: str, query: QueryBuilder | str, *params: Any) -> QueryBuilder:
        self._ctes.append((name, query, params))
        return self

    def union(self, other: QueryBuilder) -> QueryBuilder:
        self._unions.append(("UNION", other))
        return self

    def union_all(self, other: QueryBuilder) -> QueryBuilder:
        self._unions.append(("UNION ALL", other))
        return self

    # --- building

    def _name(self, table: str) -> str:
        return self._aliases.get(table, table)

    def _plan(self) -> tuple[str, list[_Join]]:
        """The root table and the joins, inferred ones first."""
        ctes = {name.lower() for name, _, _ in self._ctes}
        join_aliases = {e.alias for e in self._explicit if e.alias}
        far = {e.to_table for e in self._explicit if self.resolve_alias(e.from_name) != e.to_table}

        def first(items) -> list[str]:
            return [self.resolve_alias(t[0]) for i in items if (t := tables_in(i))]

        filtered = [self.resolve_alias(t) for t in self._where.tables()]
        selected = first(self._select)
        rest = first([i for i, _ in self._order]) + first(self._group) + [self.resolve_alias(t) for h in self._having for t in h.tables()]
        rest += [self.resolve_alias(e.from_name) for e in self._explicit]
        named = list(dict.fromkeys(filtered + selected + rest))
        real = [t for t in named if t not in ctes and t not in join_aliases and t not in far]
        if not real:
            used = [t for t in named if t in ctes]
            if not used:
                raise ValueError("no table references found in the query")
            return used[0], self._explicit_joins()
        root = real[0]
        joins, seen = [], {root}
        path = self._graph.join_path(real, root)
        waiting = list(path)
        while waiting:
            edge = next(e for e in waiting if e.from_table in seen or e.to_table in seen)
            waiting.remove(edge)
            new = edge.to_table if edge.from_table in seen else edge.from_table
            if new in seen:
                continue
            seen.add(new)
            joins.append(_Join(self._kinds.get(new, "JOIN"), new, self._name(new), edge.condition(self._name(edge.from_table), self._name(edge.to_table))))
        return root, joins + self._explicit_joins()

    def _explicit_joins(self) -> list[_Join]:
        out = []
        for e in self._explicit:
            name = e.alias or self._name(e.to_table)
            left = self._aliases.get(e.from_name, e.from_name)
            out.append(_Join(e.kind, e.to_table, name, " AND ".join(f"{left}.{a} = {name}.{b}" for a, b in zip(e.from_columns, e.to_columns, strict=True))))
        return out

    def build(self, member: bool = False) -> str:
        """The SQL text; ``member`` leaves out the order, as fits a subquery, a union's part or a common table."""
        if not self._select:
            raise ValueError("nothing is selected")
        if len(self._open) > 1:
            raise ValueError("a predicate group is still open")
        params: list = []
        lines = []
        if self._ctes:
            parts = []
            for name, query, own in self._ctes:
                if isinstance(query, str):
                    parts.append(f"{name} AS ({query})")
                    params += own
                else:
                    parts.append(f"{name} AS ({query.build(member=True)})")
                    params += query.parameters
            lines.append("WITH " + ", ".join(parts))
        root, joins = self._plan()
        lines.append(("SELECT DISTINCT " if self._distinct else "SELECT ") + ", ".join(self._select))
        lines.append(f"FROM {root}" + ("" if self._name(root) == root else f" {self._name(root)}"))
        lines += [j.render() for j in joins]
        if condition := self._where.render(params, top=True):
            lines.append("WHERE " + condition)
        if self._group:
            lines.append("GROUP BY " + ", ".join(self._group))
        if self._having:
            lines.append("HAVING " + " AND ".join(h.render(params) for h in self._having))
        for word, other in self._unions:
            lines.append(f"{word} {other.build(member=True)}")
            params += other.parameters
        if self._order and not member:
            lines.append("ORDER BY " + ", ".join(f"{i} {'ASC NULLS LAST' if up else 'DESC NULLS FIRST'}" for i, up in self._order))
        self._lines, self._parameters = lines, params
        return " ".join(lines)

    @property
    def parameters(self) -> list:
        """Bound values in the order of their marks: common tables, WHERE, HAVING, unions."""
        if self._parameters is None:
            raise ValueError("the query has not been built")
        return list(self._parameters)

    def __str__(self) -> str:
        self.build()
        return "\n".join([*self._lines, f"-- Parameters: {self._parameters}"])

    # --- running

    def to_dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        session = spark or self._spark
        if session is None:
            raise ValueError("no session to run the query in")
        text = self.build()
        found = session.sql(text, args=self.parameters) if self._parameters else session.sql(text)
        return found.limit(self._limit) if self._limit is not None and self._limit > 0 else found

    def fetch_all(self, spark: SparkSession | None = None) -> list[Row]:
        return self.to_dataframe(spark).collect()

    def fetch_one(self, spark: SparkSession | None = None) -> Row | None:
        return self.to_dataframe(spark).limit(1).first()

    def fetch_all_json(self, spark: SparkSession | None = None) -> list[str]:
        return self.to_dataframe(spark).toJSON().collect()

    def rows(self, spark: SparkSession | None = None) -> Iterator[Row]:
        """Rows one partition at a time, as from a cursor."""
        return self.to_dataframe(spark).toLocalIterator()
