"""Checked writes: constraints are validated on the rows to be written before a change set is added."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake import dialect
from braidlake import errors as E
from braidlake.catalog import Catalog, columns
from braidlake.operators.overlay import DELETED
from braidlake.storage import cut

Lookup = Callable[[str], DataFrame]


def _on(cols: Sequence[str], a: str = "n", b: str = "o") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`") == F.col(f"{b}.`{c}`") for c in cols])


def coerced(df: DataFrame, table: dict, names: Sequence[str] | None = None) -> DataFrame:
    """df's columns by position as those of the table (or the named ones), cast to their types; missing ones null."""
    every = columns(table)
    known = {c["name"].lower(): c for c in every}
    names = [c["name"] for c in every] if names is None else list(names)
    for n in names:
        if n.lower() not in known:
            raise E.SqlError(E.NO_COLUMN, f"no column {n}")
    if len(df.columns) != len(names):
        raise E.SqlError(E.SYNTAX, f"{len(df.columns)} values for {len(names)} columns")
    given = dict(zip([n.lower() for n in names], df.toDF(*[f"c{k}" for k in range(len(names))]).columns, strict=True))
    df = df.toDF(*given.values())
    return df.select(*[(F.col(given[c["name"].lower()]) if c["name"].lower() in given else F.lit(None)).cast(c["type"]).alias(c["name"]) for c in every])


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def _queried(text: Callable[..., str], table: dict, *rows: DataFrame) -> DataFrame:
    """The query text(view, ...) over one view for each of rows, so that its expressions mean what they mean in SELECT. The views are global, as rows may come from other sessions."""
    spark, views = rows[0].sparkSession, [f"__dml_{uuid.uuid4().hex}" for _ in rows]
    for view, df in zip(views, rows, strict=True):
        df.createOrReplaceGlobalTempView(view)
    try:
        return spark.sql(dialect.rewritten(spark, text(*[f"global_temp.{v}" for v in views]), None, lambda parts: dialect.key_of([table], parts)))
    finally:
        for view in views:
            spark.catalog.dropGlobalTempView(view)


def check_rows(new: DataFrame, table: dict) -> None:
    """NOT NULL, CHECK and duplicate keys within the new rows."""
    for c in columns(table):
        if not c["nullable"] and _any(new.filter(F.col(f"`{c['name']}`").isNull())):
            raise E.SqlError(E.NOT_NULL, f"null in column {c['name']}")
    for text in table["checks"]:
        if _any(_queried(lambda view, text=text: f"select 1 from {view} where not coalesce(({text}), true)", table, new)):
            raise E.SqlError(E.CHECK, f"check ({text}) fails")
    for keys in [table["pk"], *table["unique"]]:
        present = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
        if _any(new.filter(present).groupBy(*keys).count().filter("count > 1")):
            raise E.SqlError(E.UNIQUE, f"duplicate key ({', '.join(keys)}) in the statement")


def check_others(new: DataFrame, table: dict, rows: Lookup, replaces: bool = False) -> None:
    """UNIQUE against the other rows of the table, foreign keys against their parents. replaces: rows of the same primary key give way."""
    old = rows(table["name"])
    for keys in ([] if replaces else [table["pk"]]) + table["unique"]:
        hit = new.alias("n").join(old.alias("o"), _on(keys))
        if replaces:
            hit = hit.filter(~_on(table["pk"]))
            rest = new.alias("n").select(*[F.col(f"n.`{k}`") for k in table["pk"]])
            hit = hit.select("o.*").join(rest, table["pk"], "left_anti")
        if _any(hit):
            raise E.SqlError(E.UNIQUE, f"key ({', '.join(keys)}) exists")
    for f in table["foreign"]:
        parent = rows(f["table"])
        if f["table"] == table["name"]:
            parent = parent.unionByName(new)
        present = reduce(lambda a, b: a & b, [F.col(f"n.`{k}`").isNotNull() for k in f["columns"]])
        pairs = reduce(lambda a, b: a & b, [F.col(f"n.`{c}`") == F.col(f"o.`{p}`") for c, p in zip(f["columns"], f["parent"], strict=True)])
        if _any(new.alias("n").filter(present).join(parent.alias("o"), pairs, "left_anti")):
            raise E.SqlError(E.FOREIGN_KEY, f"no parent in {f['table']} for ({', '.join(f['columns'])})")


def written(catalog: Catalog, table: dict, rows: DataFrame, deleted: bool, check: Callable[[DataFrame], None] | None = None) -> tuple[dict, int]:
    """The table with rows as a further change set, and their number. The change set is written once, checked as it stands in its files, and deleted again if it fails or is empty."""
    path = catalog.write(rows.withColumn(DELETED, F.lit(deleted)), table["name"], table["pk"])
    new = catalog.read(path, table)
    try:
        n = new.count()
        if n and check:
            check(new)
    except Exception:
        catalog.discard(path)
        raise
    if not n:
        catalog.discard(path)
        return table, 0
    return table | {"changes": [*table["changes"], path]}, n


def insert(catalog: Catalog, table: dict, df: DataFrame, names: Sequence[str] | None, rows: Lookup) -> tuple[dict, int]:
    def check(new: DataFrame) -> None:
        check_rows(new, table)
        check_others(new, table, rows)

    return written(catalog, table, coerced(df, table, names), False, check)


def _replacing(catalog: Catalog, table: dict, out: DataFrame, rows: Lookup) -> tuple[dict, int]:
    def check(new: DataFrame) -> None:
        check_rows(new, table)
        check_others(new, table, rows, replaces=True)

    return written(catalog, table, out, False, check)


def upsert(catalog: Catalog, table: dict, df: DataFrame, names: Sequence[str] | None, rows: Lookup, assign: dict[str, str] | None, where: str | None = None) -> tuple[dict, int]:
    """ON CONFLICT on the primary key: DO NOTHING without assign, otherwise DO UPDATE, whose expressions see the old row under its names and the new one as excluded.name."""
    new = coerced(df, table, names)
    check = table | {"checks": [], "unique": []}
    if assign is None:
        new = new.dropDuplicates(table["pk"])
    new = cut(new)
    check_rows(new, check)
    old = rows(table["name"])
    fresh = new.alias("n").join(old.alias("o"), _on(table["pk"]), "left_anti")
    if assign is None:
        out = fresh
    else:
        lower = {k.lower(): _owned(v, table) for k, v in assign.items()}
        if set(lower) & {p.lower() for p in table["pk"]}:
            raise E.SqlError(E.UNSUPPORTED, "the primary key can't be updated")
        t = table["name"]
        cols = [f"({lower[c['name'].lower()]}) as `{c['name']}`" if c["name"].lower() in lower else f"`{t}`.`{c['name']}`" for c in columns(table)]
        on = " and ".join(f"`{t}`.`{k}` = excluded.`{k}`" for k in table["pk"])
        where = f" where {_owned(where, table)}" if where else ""
        met = _queried(lambda a, b: f"select {', '.join(cols)} from {a} as `{t}` join {b} as excluded on {on}{where}", table, old, new)
        out = fresh.unionByName(coerced(met, table))
    return _replacing(catalog, table, out, rows)


def _owned(text: str, table: dict) -> str:
    """Bare column names in an assignment mean the old row."""
    names = "|".join(sorted((re.escape(c["name"]) for c in columns(table)), key=len, reverse=True))
    parts = re.split(r"('(?:[^']|'')*')", text)
    fix = lambda s: re.sub(rf"(?<![\w.`])({names})(?![\w(`.])", lambda m: f"{table['name']}.`{m[1]}`", s, flags=re.I)
    return "".join(p if p.startswith("'") else fix(p) for p in parts)


def update(catalog: Catalog, table: dict, assign: dict[str, str], where: str | None, rows: Lookup, run: Callable[[str], DataFrame]) -> tuple[dict, int]:
    """run: how a query text becomes rows, so that expressions mean in UPDATE what they mean in SELECT."""
    lower = {k.lower(): v for k, v in assign.items()}
    known = {c["name"].lower() for c in columns(table)}
    if bad := set(lower) - known:
        raise E.SqlError(E.NO_COLUMN, f"no column {min(bad)}")
    if set(lower) & {k.lower() for k in table["pk"]}:
        raise E.SqlError(E.UNSUPPORTED, "the primary key can't be updated")
    cols = [f"({lower[c['name'].lower()]}) as `{c['name']}`" if c["name"].lower() in lower else f"`{c['name']}`" for c in columns(table)]
    out = run(f"select {', '.join(cols)} from `{table['name']}`" + (f" where {where}" if where else ""))
    return _replacing(catalog, table, coerced(out, table), rows)


def delete(catalog: Catalog, table: dict, where: str | None, run: Callable[[str], DataFrame]) -> tuple[dict, int]:
    return written(catalog, table, coerced(run(f"select * from `{table['name']}`" + (f" where {where}" if where else "")), table), True)
