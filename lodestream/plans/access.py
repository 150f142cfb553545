"""Row-level access over SQL: bound parameters, paging, counting, JSON; records with change tracking on versioned tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date, datetime, time, timezone
from zoneinfo import ZoneInfo
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.store import SnapshotTable
from .builder import QueryBuilder
from . import statements
from .graph import RelationGraph


class Database:
    """A session with a relation graph, primary keys and, for tables that change, their versioned stores."""

    def __init__(self, spark: SparkSession, graph: RelationGraph | None = None, primary_keys: dict[str, list[str]] | None = None):
        self.spark = spark
        self.graph = graph or RelationGraph()
        self.primary_keys = {t.lower(): [c.lower() for c in cols] for t, cols in (primary_keys or {}).items()}
        self.stores: dict[str, SnapshotTable] = {}
        self.delete_callback: Callable[[str, Any], None] | None = None
        self.read_only = False

    # --- reading

    def sql(self, text: str, *params: Any) -> DataFrame:
        return self.spark.sql(text, args=list(params)) if params else self.spark.sql(text)

    def query_builder(self) -> QueryBuilder:
        return QueryBuilder(self.graph, self.spark)

    def limited(self, rows: int, text: str, *params: Any) -> DataFrame:
        """The first rows; fewer than one means all."""
        found = self.sql(text, *params)
        return found.limit(rows) if rows >= 1 else found

    def page(self, page: int, rows: int, text: str, *params: Any) -> DataFrame:
        """A page, counted from zero.  The text must order its rows totally for pages to be disjoint."""
        return self.sql(text, *params).offset(page * rows).limit(rows)

    def _chosen(self, text: str, params: tuple, limit: int | None, page: int | None) -> DataFrame:
        if page is not None:
            return self.page(page, limit or 0, text, *params)
        return self.limited(limit or 0, text, *params)

    def fetch_all(self, text: str, *params: Any, limit: int | None = None, page: int | None = None) -> list[Row]:
        return self._chosen(text, params, limit, page).collect()

    def fetch_one(self, text: str, *params: Any) -> Row | None:
        return self.sql(text, *params).limit(1).first()

    def fetch_all_json(self, text: str, *params: Any, limit: int | None = None, page: int | None = None) -> list[dict]:
        return [as_json(r) for r in self.fetch_all(text, *params, limit=limit, page=page)]

    def fetch_one_json(self, text: str, *params: Any, into: dict | None = None) -> dict | None:
        """One row as a dictionary, merged into ``into`` where that is given."""
        row = self.fetch_one(text, *params)
        if row is None:
            return into
        return (into if into is not None else {}) | as_json(row)

    def fetch_count(self, text: str, *params: Any) -> int:
        return self.sql(text, *params).count()

    def exists(self, text: str, *params: Any) -> bool:
        return not self.sql(text, *params).isEmpty()

    def cursor(self, text: str, *params: Any, limit: int | None = None, page: int | None = None) -> Iterator[Row]:
        return self._chosen(text, params, limit, page).toLocalIterator()

    def cursor_with_count(self, text: str, *params: Any) -> tuple[int, Iterator[Row]]:
        """The number of rows and the rows themselves."""
        return self.fetch_count(text, *params), self.cursor(text, *params)

    # --- changing

    def execute(self, text: str, *params: Any) -> int:
        """INSERT, UPDATE or DELETE on an attached table; returns the number of rows.  Each statement is one new version, complete or not there."""
        if self.read_only:
            raise PermissionError("the database is read-only")
        s = statements.parse(text)
        if s.table not in self.stores:
            raise KeyError(f"no attached table {s.table}")
        self.refresh(s.table)
        store = self.stores[s.table]
        if s.kind == "insert":
            names = list(s.columns) or [f.name for f in store.schema]
            rows = self.sql(f"SELECT * FROM ({s.source})", *params)
            if len(rows.columns) != len(names):
                raise ValueError(f"{len(names)} columns, {len(rows.columns)} values")
            rows = rows.toDF(*names)
            changed = rows.count()
            store.append(rows)
        else:
            hit = f"coalesce(({s.condition}), false)" if s.condition else "true"
            n_set = sum(re.sub(r"'[^']*'", "", v).count("?") for v in s.values)
            changed = self.fetch_count(f"SELECT 1 FROM {s.table} WHERE {hit}", *params[n_set:])
            if changed:
                # parameters keep their order: the assignments stand before the condition
                values = {c: v for c, v in zip(s.columns, s.values, strict=True)}
                listed = ", ".join(f"CASE WHEN _hit THEN ({values[f.name.lower()]}) ELSE {f.name} END AS {f.name}" if f.name.lower() in values else f.name for f in sorted(store.schema, key=lambda f: s.columns.index(f.name.lower()) if f.name.lower() in values else -1))
                tail = "WHERE NOT _hit" if s.kind == "delete" else ""
                store.write(self.sql(f"SELECT {listed} FROM (SELECT *, {hit} AS _hit FROM {s.table}) {tail}", *params))
        self.refresh(s.table)
        return changed

    # --- catalog

    def table_exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def columns(self, table: str) -> dict[str, str]:
        """Column names, in lower case, and their types."""
        return {f.name.lower(): f.dataType.simpleString() for f in self.spark.table(table).schema}

    def column_size(self, table: str, column: str) -> int | None:
        """The length of a CHAR or VARCHAR column, the digits of a decimal one; None where a type has no size."""
        field = next((f for f in self.spark.table(table).schema if f.name.lower() == column.lower()), None)
        if field is None:
            raise KeyError(f"no column {column} in {table}")
        stated = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", field.dataType.simpleString())
        inner = stated.partition("(")[2].rstrip(")")
        return int(inner.split(",")[0]) if inner and stated.startswith(("char", "varchar", "decimal")) else None

    def primary_columns(self, table: str) -> list[str]:
        return self.primary_keys.get(table.lower(), [])

    def use(self, schema: str) -> None:
        self.spark.catalog.setCurrentDatabase(schema)

    @property
    def schema(self) -> str:
        return self.spark.catalog.currentDatabase()

    # --- records

    def attach(self, table: str, store: SnapshotTable, keys: list[str]) -> None:
        """Make a versioned table available to records and, as a view, to SQL."""
        self.stores[table.lower()] = store
        self.primary_keys[table.lower()] = [k.lower() for k in keys]
        self.refresh(table)

    def refresh(self, table: str) -> None:
        self.stores[table.lower()].read().createOrReplaceTempView(table.lower())

    def new_record(self, table: str) -> Record:
        return Record(self, table.lower())

    def record(self, table: str, text: str, *params: Any) -> Record | None:
        row = self.fetch_one(text, *params)
        return None if row is None else Record(self, table.lower(), {k.lower(): v for k, v in row.asDict().items()})


class Record:
    """One row of a table that can change: columns by lower-case name, with what they were when read.

    Writes go to the table's store as one new version each; for many rows use the store's own ``append`` and ``upsert``.
    """

    def __init__(self, db: Database, table: str, values: dict[str, Any] | None = None):
        self._db, self._table = db, table
        self._now: dict[str, Any] = dict(values or {})
        self._was: dict[str, Any] = dict(values or {})

    def set(self, name: str, value: Any) -> Record:
        self._now[name.lower()] = value
        return self

    def get(self, name: str) -> Any:
        if name.lower() not in self._now:
            raise KeyError(f"no column {name} in {self._table}")
        return self._now[name.lower()]

    __getitem__ = get

    def __setitem__(self, name: str, value: Any) -> None:
        self.set(name, value)

    def has(self, name: str) -> bool:
        return name.lower() in self._now

    def _number(self, name: str, kinds: tuple) -> Any:
        value = self.get(name)
        if value is None or (isinstance(value, kinds) and not isinstance(value, bool)):
            return value
        if isinstance(value, Decimal) and value == value.to_integral_value():
            return int(value)
        raise TypeError(f"{name} holds {type(value).__name__}")

    def get_int(self, name: str) -> int | None:
        return self._number(name, (int,))

    def get_float(self, name: str) -> float | None:
        value = self._number(name, (int, float))
        return None if value is None else float(value)

    def get_decimal(self, name: str) -> Decimal | None:
        value = self.get(name)
        return None if value is None else Decimal(value) if isinstance(value, (int, str, Decimal)) else Decimal(repr(value))

    def get_string(self, name: str) -> str | None:
        value = self.get(name)
        if value is not None and not isinstance(value, str):
            raise TypeError(f"{name} holds {type(value).__name__}")
        return value

    def get_date_int(self, name: str) -> int:
        """A date as YYYYMMDD, null as 0."""
        value = self.get(name)
        return 0 if value is None else value.year * 10000 + value.month * 100 + value.day

    def get_date(self, name: str) -> date | None:
        value = self.get(name)
        return value.date() if isinstance(value, datetime) else value

    def get_datetime(self, name: str, zone: str | None = None) -> datetime | None:
        """A date-time, moved into a zone where one is named; one without a zone is taken as UTC."""
        value = self.get(name)
        if value is None or zone is None:
            return value
        return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).astimezone(ZoneInfo(zone))

    def get_datetime_ms(self, name: str) -> int:
        """Epoch milliseconds, null as 0."""
        value = self.get_datetime(name, "UTC")
        return 0 if value is None else int(value.timestamp() * 1000)

    def get_time_ms(self, name: str) -> int:
        """Milliseconds since midnight, null as 0."""
        value = self.get(name)
        return 0 if value is None else ((value.hour * 60 + value.minute) * 60 + value.second) * 1000 + value.microsecond // 1000

    def get_bytes(self, name: str) -> bytes | None:
        value = self.get(name)
        return None if value is None else bytes(value)

    def set_date(self, name: str, value: int | date | None) -> Record:
        """A date, or YYYYMMDD; 0 is null."""
        if isinstance(value, int):
            value = date(value // 10000, value // 100 % 100, value % 100) if value else None
        return self.set(name, value)

    def set_time(self, name: str, value: int | time | None) -> Record:
        """A time, or HHMM; kept as text, for Spark tables have no type of their own for it."""
        if isinstance(value, int):
            value = time(value // 100, value % 100)
        return self.set(name, None if value is None else value.isoformat())

    def set_datetime(self, name: str, value: int | datetime | None) -> Record:
        """A date-time, or epoch milliseconds; 0 is null."""
        if isinstance(value, int):
            value = datetime.fromtimestamp(value / 1000, timezone.utc).replace(tzinfo=None) if value else None
        return self.set(name, value)

    @property
    def changed(self) -> dict[str, Any]:
        return {k: v for k, v in self._now.items() if k not in self._was or self._was[k] != v}

    def to_json(self, into: dict | None = None) -> dict:
        """The row as JSON values, merged into ``into`` where that is given."""
        return (into if into is not None else {}) | as_json(self._now)

    def copy_corresponding(self, other: Record) -> Record:
        """Take over columns that both have, with values of the same type."""
        for name, value in other._now.items():
            if name in self._now and (value is None or self._now[name] is None or type(self._now[name]) is type(value)):
                self._now[name] = value
        return self

    def copy(self, other: Record) -> Record:
        self._now.update(other._now)
        return self

    @property
    def _keys(self) -> list[str]:
        keys = self._db.primary_columns(self._table)
        if not keys:
            raise ValueError(f"{self._table} has no primary key")
        return keys

    @property
    def _store(self) -> SnapshotTable:
        return self._db.stores[self._table]

    def _frame(self, values: dict[str, Any]) -> DataFrame:
        schema = self._store.schema
        return self._db.spark.createDataFrame([tuple(values.get(f.name.lower()) for f in schema)], schema)

    def add(self) -> None:
        """Append the row; columns without a value are null."""
        self._store.append(self._frame(self._now))
        self._saved()

    def add_auto(self) -> int:
        """Append with the next number in the first key column."""
        key = self._keys[0]
        top = self._store.read().agg(F.max(key)).first()[0]
        self._now[key] = (top or 0) + 1
        self.add()
        return self._now[key]

    def update(self) -> bool:
        """Write the changed columns to the row with the key as it was read; False if nothing changed."""
        changed = self.changed
        if not changed:
            return False
        match = self._match()
        self._store.replace(lambda df: df.withColumns({f.name: F.when(match, F.lit(changed[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f.name)) for f in df.schema if f.name.lower() in changed}))
        self._saved()
        return True

    def delete(self) -> None:
        match = self._match()
        self._store.replace(lambda df: df.filter(~F.coalesce(match, F.lit(False))))
        if self._db.delete_callback and len(self._keys) == 1:
            self._db.delete_callback(self._table, self._was[self._keys[0]])
        self._db.refresh(self._table)

    def _match(self):
        condition = F.lit(True)
        for key in self._keys:
            condition = condition & (F.col(key) == F.lit(self._was[key]))
        return condition

    def _saved(self) -> None:
        self._was = dict(self._now)
        self._db.refresh(self._table)


def as_json(row: Row | dict) -> dict:
    """A row as a dictionary of JSON values; dates in ISO form."""
    values = row.asDict(recursive=True) if isinstance(row, Row) else row
    return json.loads(json.dumps(values, default=lambda v: v.isoformat() if isinstance(v, (date, datetime)) else float(v) if isinstance(v, Decimal) else str(v)))
