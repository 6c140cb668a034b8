"""MERGE BRANCH: three-way per table, then per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake import errors as E
from braidlake.catalog import Catalog, columns, extends
from braidlake.dml import check_others
from braidlake.operators.overlay import DELETED, three_way
from braidlake.storage import cut


def common_ancestor(catalog: Catalog, a: str, b: str) -> str:
    """The highest commit that both have among their ancestors."""

    def closure(name: str) -> dict[str, int]:
        out, todo = {}, [name]
        while todo:
            n = todo.pop()
            if n not in out:
                c = catalog.commit(n)
                out[n] = c["height"]
                todo += c["parents"]
        return out

    x, y = closure(a), closure(b)
    return max(x.keys() & y.keys(), key=lambda n: (x[n], n))


def _shape(t: dict | None) -> object:
    return None if t is None else (columns(t), t["pk"], t["unique"], t["checks"], t["foreign"])


def _data(t: dict | None) -> object:
    return None if t is None else (t["base"], t["changes"], _shape(t))


def _by_changes(catalog: Catalog, tb: dict, tx: dict, ty: dict, name: str) -> dict:
    """Two versions that only add change sets to the ancestor: keys changed on one side alone need no data to be written, as the change sets are put
    one after the other; keys changed on both are compared with the ancestor, and what they come to is one further change set."""
    pk, k = tx["pk"], len(tb["changes"])
    keys = catalog.changes(ty, k).select(*pk).distinct().join(catalog.changes(tx, k).select(*pk).distinct(), pk, "left_semi")
    both = cut(keys)
    changes = [*tx["changes"], *ty["changes"][k:]]
    if not both.isEmpty():
        some = lambda t: catalog.rows(t).join(both, pk, "left_semi").select(*[c["name"] for c in columns(tx)])
        rows = cut(three_way(some(tb | {"columns": tx["columns"], "extensions": tx["extensions"]}), some(tx), some(ty), pk))
        _agreed(rows, pk, name)
        kept = rows.filter("__state = 'keep'").drop("__state").withColumn(DELETED, F.lit(False))
        gone = both.join(kept.select(*pk), pk, "left_anti").select(*[(F.col(f"`{c['name']}`") if c["name"] in pk else F.lit(None).cast(c["type"])).alias(c["name"]) for c in columns(tx)], F.lit(True).alias(DELETED))
        changes.append(catalog.write(kept.unionByName(gone), tx["name"], pk))
    return tx | {"changes": changes}


def _agreed(rows: DataFrame, pk: list[str], name: str) -> None:
    bad = rows.filter("__state = 'conflict'").select(*pk).limit(3).collect()
    if bad:
        raise E.SqlError(E.CONFLICT, f"table {name}: conflicting keys " + ", ".join(str(tuple(r)) for r in bad))


def merge(catalog: Catalog, source: str, target: str) -> str:
    """Merges source into target and gives the merge commit; a conflict is an error that names up to three keys, and nothing is changed.

    The merge is published on the head that it has read. A commit of another writer in the meantime makes it start again on
    the newer one, five times at most. UNIQUE, CHECK and FOREIGN KEY are checked again on the rows that the source brings in.
    """
    for attempt in range(5):
        try:
            return _merged(catalog, source, target)
        except E.SqlError as e:
            if "has moved on" not in str(e) or attempt == 4:
                raise
    raise AssertionError


def _merged(catalog: Catalog, source: str, target: str) -> str:
    right = catalog.checkpoint(source)
    seen, head = catalog.checkpointed(target)
    left = head["commit"]
    base = common_ancestor(catalog, left, right)
    if base == right:
        return left
    b, x, y = (catalog.commit(n)["tables"] for n in (base, left, right))
    out: dict[str, dict] = {}
    both: list[str] = []
    for name in sorted({*b, *x, *y}):
        tb, tx, ty = b.get(name), x.get(name), y.get(name)
        if _data(ty) == _data(tb) or _data(tx) == _data(ty):
            pick = tx
        elif _data(tx) == _data(tb):
            pick = ty
        elif tx is None or ty is None or tb is None or _shape(tx) != _shape(ty):
            raise E.SqlError(E.CONFLICT, f"table {name} was changed in different ways")
        else:
            if extends(tb, tx) and extends(tb, ty):
                pick = _by_changes(catalog, tb, tx, ty, name)
            else:
                rows = cut(three_way(catalog.rows(tb | {"columns": tx["columns"], "extensions": tx["extensions"]}), catalog.rows(tx), catalog.rows(ty), tx["pk"]))
                _agreed(rows, tx["pk"], name)
                pick = tx | {"base": [catalog.write(rows.filter(F.col("__state") == "keep").drop("__state"), tx["name"], tx["pk"])], "changes": []}
            both.append(name)
        if pick is not None:
            out[name] = pick
    lookup = lambda n: catalog.rows(next(t for k, t in out.items() if k.lower() == n.lower()))
    for name, t in out.items():
        # a table that only one side has changed can still lack parents that the other has deleted
        if t["unique"] and name in both or t["foreign"] and t is not x.get(name):
            new = catalog.difference(x[name], t).filter("new is not null").select(*t["pk"], "new.*").select(*[c["name"] for c in columns(t)]) if name in x and _shape(x[name]) == _shape(t) else catalog.rows(t)
            check_others(cut(new), t, lookup, replaces=True)
    commit = catalog._commit(out, [left, right], target, f"merge {source}")
    catalog.publish(target, seen, head | {"commit": commit, "tables": out, "dirty": False})
    return commit
