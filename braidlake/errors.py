"""Errors with SQLSTATE codes."""


class SqlError(Exception):
    """An error of the engine; sqlstate is the five-character code."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{sqlstate}: {message}")
        self.sqlstate = sqlstate


#: Codes in use, by meaning.
SYNTAX, NO_COLUMN, NO_TABLE, TABLE_EXISTS, COLUMN_EXISTS = "42601", "42703", "42P01", "42P07", "42701"
NOT_NULL, FOREIGN_KEY, UNIQUE, CHECK = "23502", "23503", "23505", "23514"
BAD_TEXT, OUT_OF_RANGE, WRONG_TYPE, BY_ZERO, BAD_VALUE = "22P02", "22003", "42804", "22012", "22023"
CONFLICT, IN_TRANSACTION, FAILED_TRANSACTION, NO_CURSOR, NO_BRANCH = "40001", "25001", "25P02", "34000", "3D000"
DENIED, UNSUPPORTED, CANCELLED, TOO_MUCH = "42501", "0A000", "57014", "54000"
