"""Foreign-key relations between tables, and the shortest way to join a set of tables along them.

Spark's catalogs carry no foreign keys, so Catalyst cannot find join paths; this graph can.  It lives on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

#: First line of a saved graph (a fixed value of the file format).
HEADER = "# SchemaGraph cache v1"


@dataclass(frozen=True)
class Edge:
    """A foreign key: the columns of one table that refer to as many columns of another."""

    from_table: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]

    @property
    def composite(self) -> bool:
        return len(self.from_columns) > 1

    def other(self, table: str) -> str:
        return self.to_table if table == self.from_table else self.from_table

    def condition(self, from_name: str | None = None, to_name: str | None = None) -> str:
        left, right = from_name or self.from_table, to_name or self.to_table
        return " AND ".join(f"{left}.{a} = {right}.{b}" for a, b in zip(self.from_columns, self.to_columns, strict=True))


_CACHED: dict[tuple[str, str | None], RelationGraph] = {}


class RelationGraph:
    """Tables and foreign keys; names are case-insensitive and kept in lower case, in order of declaration."""

    def __init__(self):
        self._edges: dict[str, list[Edge]] = {}

    def add_table(self, table: str) -> RelationGraph:
        self._edges.setdefault(table.lower(), [])
        return self

    def add_foreign_key(self, from_table: str, from_columns: str | Sequence[str], to_table: str, to_columns: str | Sequence[str]) -> RelationGraph:
        """Declare a key of one column or several.  A repeated declaration is ignored."""
        own = (from_columns,) if isinstance(from_columns, str) else tuple(from_columns)
        far = (to_columns,) if isinstance(to_columns, str) else tuple(to_columns)
        if not own or len(own) != len(far):
            raise ValueError(f"a foreign key needs as many columns on either side: {own} and {far}")
        edge = Edge(from_table.lower(), tuple(c.lower() for c in own), to_table.lower(), tuple(c.lower() for c in far))
        for table in dict.fromkeys((edge.from_table, edge.to_table)):
            self.add_table(table)
            if edge not in self._edges[table]:
                self._edges[table].append(edge)
        return self

    def has_table(self, table: str) -> bool:
        return table.lower() in self._edges

    @property
    def tables(self) -> list[str]:
        return list(self._edges)

    def edges(self, table: str | None = None) -> list[Edge]:
        """The keys at a table, or every key once."""
        if table is not None:
            return list(self._edges.get(table.lower(), []))
        return list(dict.fromkeys(e for edges in self._edges.values() for e in edges))

    def _nearest(self, joined: Iterable[str], wanted: set[str]) -> list[Edge] | None:
        """The shortest chain of keys from any joined table to any wanted one; keys declared first win ties."""
        came: dict[str, Edge | None] = dict.fromkeys(joined)
        queue = deque(came)
        while queue:
            table = queue.popleft()
            if table in wanted:
                chain = []
                while (edge := came[table]) is not None:
                    chain.append(edge)
                    table = edge.other(table)
                return chain[::-1]
            for edge in self._edges.get(table, []):
                if (far := edge.other(table)) not in came:
                    came[far] = edge
                    queue.append(far)
        return None

    def join_path(self, tables: Iterable[str], root: str) -> list[Edge]:
        """Keys that connect all ``tables`` to ``root``, in joining order, through other tables where need be.

        Whichever table is nearest to those joined so far comes next.
        """
        root = root.lower()
        joined = {root: None}
        wanted = {t.lower(): None for t in tables if t.lower() != root}
        path: list[Edge] = []
        while wanted:
            chain = self._nearest(joined, set(wanted))
            if chain is None:
                raise ValueError(f"no join path from {sorted(joined)} to {sorted(wanted)}")
            for edge in chain:
                path.append(edge)
                joined.setdefault(edge.from_table)
                joined.setdefault(edge.to_table)
            for table in joined:
                wanted.pop(table, None)
        return path

    @classmethod
    def from_jdbc(cls, spark, url: str, schema: str | None = None, properties: dict[str, str] | None = None, fresh: bool = False) -> RelationGraph:
        """Tables and foreign keys of a database, read once for each address and schema from its driver's metadata.

        Keys of several columns are put together by name, in the order of their columns.
        """
        if not fresh and (url, schema) in _CACHED:
            return _CACHED[url, schema]
        settings = spark._jvm.java.util.Properties()
        for name, value in (properties or {}).items():
            settings.setProperty(name, value)
        connection = spark._jvm.java.sql.DriverManager.getConnection(url, settings)
        try:
            about = connection.getMetaData()
            kinds = spark._sc._gateway.new_array(spark._jvm.String, 1)
            kinds[0] = "TABLE"
            found = about.getTables(None, schema, "%", kinds)
            tables = []
            while found.next():
                tables.append((found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME")))
            graph = cls()
            for _, table in tables:
                graph.add_table(table)
            for own_schema, table in tables:
                keys: dict[tuple[str, str], list[tuple[int, str, str]]] = {}
                columns = about.getImportedKeys(None, own_schema, table)
                while columns.next():
                    name = (columns.getString("PKTABLE_NAME"), columns.getString("FK_NAME") or "")
                    keys.setdefault(name, []).append((columns.getInt("KEY_SEQ"), columns.getString("FKCOLUMN_NAME"), columns.getString("PKCOLUMN_NAME")))
                for (far, _), parts in keys.items():
                    parts.sort()
                    graph.add_foreign_key(table, [p[1] for p in parts], far, [p[2] for p in parts])
        finally:
            connection.close()
        _CACHED[url, schema] = graph
        return graph

    def save(self, path: str) -> None:
        lines = [HEADER, *(f"TABLE {t}" for t in sorted(self._edges))]
        lines += [f"FK {e.from_table} {','.join(e.from_columns)} {e.to_table} {','.join(e.to_columns)}" for e in self.edges()]
        Path(path).write_text("\n".join(lines) + "\n")

    @classmethod
    def load(cls, path: str) -> RelationGraph:
        """Read a saved graph.  Comments and blank lines are allowed after the header; anything else that is no entry raises."""
        lines = Path(path).read_text().splitlines()
        if not lines or lines[0].strip() != HEADER:
            raise ValueError(f"{path} does not begin with '{HEADER}'")
        graph = cls()
        for number, line in enumerate(lines[1:], 2):
            fields = line.split()
            if not fields or fields[0].startswith("#"):
                continue
            if fields[0] == "TABLE" and len(fields) == 2:
                graph.add_table(fields[1])
            elif fields[0] == "FK" and len(fields) == 5:
                graph.add_foreign_key(fields[1], fields[2].split(","), fields[3], fields[4].split(","))
            else:
                raise ValueError(f"{path}, line {number}: neither a table nor a key: {line!r}")
        return graph
