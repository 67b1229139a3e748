"""Roles, grants, and reads filtered by them; the describing views of a store."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.errors import EngineError
from geolith.operators.layout import spatial_kind
from geolith.sources.store import Store

PUBLIC = "public"
PRIVILEGES = {"SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN"}
NEVER = {"TRUNCATE", "REFERENCES", "TRIGGER"}


@dataclass
class Roles:
    """Roles with memberships (member, role, inherit, set), owners and grants of tables."""

    names: set[str]
    members: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    owners: dict[str, str] = field(default_factory=dict)
    grants: dict[tuple[str, str], set[str]] = field(default_factory=dict)

    def __post_init__(self):
        for member, role, *_ in self.members:
            if member not in self.names or role not in self.names:
                raise EngineError("42704", f"no role {member} or {role}")
            if member in self.closure(role):
                raise EngineError("0LP01", "memberships go round in a circle")

    def closure(self, role: str, by: int | None = None) -> set[str]:
        """The role and all it is a member of; by 2 those it inherits from, by 3 those it may become."""
        found, todo = {role}, [role]
        while todo:
            at = todo.pop()
            for edge in self.members:
                if edge[0] == at and (by is None or edge[by]) and edge[1] not in found:
                    found.add(edge[1])
                    todo.append(edge[1])
        return found

    def has(self, role: str, table: str, privilege: str) -> bool:
        """Whether a role may; privileges in a comma list count each by itself."""
        wanted = {p.strip().upper() for p in privilege.split(",")}
        if unknown := wanted - PRIVILEGES:
            raise EngineError("22023", f"no privilege {sorted(unknown)[0]}")
        mine = self.closure(role, 2)
        if self.owners.get(table) in mine:
            return bool(wanted - NEVER)
        held = set().union(*(self.grants.get((r, table), set()) for r in mine | {PUBLIC}))
        return bool((wanted - NEVER) & held)


class Session:
    """A store as one role sees it."""

    def __init__(self, store: Store, roles: Roles, role: str):
        if role not in roles.names:
            raise EngineError("42704", f"no role {role}")
        self.store, self.roles, self.login, self.role = store, roles, role, role
        self.epoch = 0

    def set_role(self, role: str | None) -> None:
        """Become another role, or the login's again."""
        if role is not None and role not in self.roles.closure(self.login, 3):
            raise EngineError("42501", f"{self.login} can't become {role}")
        self.role = role or self.login
        self.epoch += 1

    def _need(self, table: str, privilege: str) -> None:
        if not self.roles.has(self.role, table, privilege):
            raise EngineError("42501", f"{self.role} has no {privilege} on {table}")

    def read(self, table: str) -> DataFrame:
        self._need(table, "SELECT")
        return self.store.read(table)

    def append(self, table: str, df: DataFrame) -> None:
        self._need(table, "INSERT")
        self.store.append(table, df)

    def delete(self, table: str, where) -> None:
        self._need(table, "DELETE")
        self.store.delete(table, where)

    def visible(self) -> list[str]:
        return [t for t in self.store.tables() if self.roles.has(self.role, t, ",".join(sorted(PRIVILEGES)))]

    # describing views
    def tables(self) -> DataFrame:
        rows = [("geolith", "public", t, "BASE TABLE", self.store.manifest(t).comment) for t in self.visible()]
        return self.store.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string, comment string")

    def columns(self) -> DataFrame:
        rows = [("public", t, f.name, i, "YES" if f.nullable else "NO", type_name(f.dataType), self.store.manifest(t).comments.get(f.name)) for t in self.visible() for i, f in enumerate(self.store.schema(t), 1)]
        return self.store.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string, comment string")

    def geometry_columns(self) -> DataFrame:
        rows = [("public", t, f.name, 2, 0, "GEOMETRY") for t in self.visible() for f in self.store.schema(t) if spatial_kind(f.name, f.dataType) == "geometry"]
        return self.store.spark.createDataFrame(rows, "f_table_schema string, f_table_name string, f_geometry_column string, coord_dimension int, srid int, type string")

    def table_privileges(self) -> DataFrame:
        rows = [(r, t, p) for (r, t), held in sorted(self.roles.grants.items()) for p in sorted(held - {"MAINTAIN"}) if t in self.visible()]
        return self.store.spark.createDataFrame(rows, "grantee string, table_name string, privilege_type string")


_TYPES = {T.BooleanType: "bool", T.ByteType: "char", T.ShortType: "int2", T.IntegerType: "int4", T.LongType: "int8", T.FloatType: "float4", T.DoubleType: "float8", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.StringType: "text", T.BinaryType: "bytea"}


def type_name(kind: T.DataType) -> str:
    """A column type's name; structs and maps have none."""
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if type(kind) not in _TYPES:
        raise EngineError("0A000", f"no catalogue name for {kind.simpleString()}")
    return _TYPES[type(kind)]


_COMPARE = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
_RESERVED = {"select", "order", "limit", "offset"}


def _test(kinds: dict[str, str], name: str, text: str) -> Column:
    """The condition `name=text`."""
    if name not in kinds:
        raise EngineError("42703", f"no column {name}")
    op, _, value = text.partition(".")
    negated = op == "not"
    if negated:
        op, _, value = value.partition(".")
    c = F.col(f"`{name}`")
    if op in _COMPARE:
        test = getattr(c, _COMPARE[op])(F.lit(value).cast(kinds[name]))
    elif op in ("like", "ilike"):
        test = getattr(c, op)(value.replace("*", "%"))
    elif op == "in" and value[:1] == "(" and value[-1:] == ")":
        test = c.isin([F.lit(v.strip('"')).cast(kinds[name]) for v in value[1:-1].split(",")])
    elif op == "is" and value in ("null", "true", "false"):
        test = c.isNull() if value == "null" else c.eqNullSafe(F.lit(value == "true"))
    else:
        raise EngineError("22023", f"{text!r} is no filter")
    return ~test if negated else test


def _group(kinds: dict[str, str], how: str, text: str, depth: int) -> Column:
    """`(a.eq.1,and(b.gt.2,c.is.null))` joined by `how`; groups nest up to eight deep."""
    if depth > 8 or text[:1] != "(" or text[-1:] != ")":
        raise EngineError("22023", f"{text!r} is no group of filters")
    parts, level = [""], 0
    for sign in text[1:-1]:
        level += (sign == "(") - (sign == ")")
        if sign == "," and level == 0:
            parts.append("")
        else:
            parts[-1] += sign
    found = []
    for part in parts:
        inner = re.fullmatch(r"(not\.)?(and|or)(\(.*\))", part, re.S)
        if inner:
            test = _group(kinds, inner[2], inner[3], depth + 1)
            found.append(~test if inner[1] else test)
        else:
            name, dot, rest = part.partition(".")
            if not dot:
                raise EngineError("22023", f"{part!r} is no filter")
            found.append(_test(kinds, name, rest))
    return reduce(lambda a, b: a & b if how == "and" else a | b, found)


def filtered(df: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """Rows by request parameters: select, column=op.value, and/or groups, order, limit and offset.

    Values are compared as the column's type. Nulls come last in either order.
    """
    kinds = dict(df.dtypes)
    for name, text in parameters.items():
        if name in ("and", "or"):
            df = df.where(_group(kinds, name, text, 0))
        elif name not in _RESERVED:
            df = df.where(_test(kinds, name, text))
    if order := parameters.get("order"):
        keys = []
        for part in order.split(","):
            name, *how = part.split(".")
            if name not in kinds or any(h not in ("asc", "desc", "nullsfirst", "nullslast") for h in how):
                raise EngineError("22023", f"{part!r} is no order")
            down, first = "desc" in how, "nullsfirst" in how
            keys.append(getattr(F.col(f"`{name}`"), f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")())
        df = df.orderBy(*keys)
    for name in ("offset", "limit"):
        if (n := parameters.get(name)) is not None:
            if not n.isdigit():
                raise EngineError("22023", f"{name} must be a number from 0")
            df = getattr(df, name)(int(n))
    wanted = [c.strip() for c in parameters.get("select", "*").split(",")]
    if bad := [c for c in wanted if c != "*" and c not in kinds]:
        raise EngineError("42703", f"no column {bad[0]}")
    return df if wanted == ["*"] else df.select(*wanted)


def json_rows(df: DataFrame) -> Iterator[str]:
    """The pieces of one JSON array of the rows, in their order, a partition at a time on the driver."""
    names = [F.col(f"`{c}`") for c in df.columns]
    yield "["
    for i, r in enumerate(df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).toLocalIterator(prefetchPartitions=False)):
        yield ("," if i else "") + r[0]
    yield "]"


def as_json(df: DataFrame, most: int = 8 << 20) -> str:
    """One JSON array of the rows; a result of more than `most` characters is refused, `json_rows` streams it."""
    out, size = [], 0
    for piece in json_rows(df):
        size += len(piece)
        if size > most:
            raise EngineError("54000", "the result is too large for one answer")
        out.append(piece)
    return "".join(out)
