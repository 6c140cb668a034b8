"""Key-value view of a branch: byte keys and values in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake import dml
from braidlake.session import Session

TABLE = "__kv"


class KV:
    """get, put, delete, scan and compare-and-set through a session, so branches, transactions and conflicts are the session's."""

    def __init__(self, session: Session):
        self.session = session
        session.sql(f"create table if not exists {TABLE} (k bytea primary key, v bytea)")

    def _one(self, key: bytes, value: bytes | None) -> DataFrame:
        return self.session.spark.createDataFrame([(bytearray(key), None if value is None else bytearray(value))], "k binary, v binary")

    def get(self, key: bytes) -> bytes | None:
        row = self.session.table(TABLE).filter(F.col("k") == F.lit(bytearray(key))).first()
        return None if row is None or row["v"] is None else bytes(row["v"])

    def put(self, key: bytes, value: bytes) -> None:
        self.put_all(self._one(key, value))

    def put_all(self, pairs: DataFrame) -> int:
        """Writes many pairs (k, v) at once; the way for loads."""
        return self.session.put(TABLE, pairs, None, "update", {"v": "excluded.v"})

    def delete(self, key: bytes) -> bool:
        return bool(self.session._write(lambda t: dml.delete(self.session.catalog, t, f"k = X'{key.hex()}'", self.session._compiled), TABLE))

    def scan(self, start: bytes = b"", end: bytes | None = None) -> DataFrame:
        """Pairs with start <= k < end in byte order."""
        df = self.session.table(TABLE).filter(F.col("k") >= F.lit(bytearray(start)))
        return (df if end is None else df.filter(F.col("k") < F.lit(bytearray(end)))).orderBy("k")

    def cas(self, key: bytes, expect: bytes | None, new: bytes | None) -> bool:
        """Writes new (None: deletes) if the value is expect (None: absent); in a transaction of its own unless one is open, so a rival writer of the key wins or conflicts."""
        own = self.session.txn is None
        if own:
            self.session.begin()
        if self.get(key) != expect:
            if own:
                self.session.rollback()
            return False
        if new is None:
            self.delete(key)
        else:
            self.put(key, new)
        if own:
            self.session.commit()
        return True

    def begin(self) -> None:
        self.session.begin()

    def commit(self) -> None:
        self.session.commit()

    def rollback(self) -> None:
        self.session.rollback()

    def use_branch(self, name: str) -> None:
        self.session.sql(f"use branch {name}")
