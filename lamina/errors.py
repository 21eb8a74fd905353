"""What can go wrong, as one hierarchy: storage, statements, table engines."""

from __future__ import annotations


class LaminaError(Exception):
    """Base of all errors that this package raises itself."""


class StorageError(LaminaError):
    """Databases, tables and parts."""


class DatabaseNotFound(StorageError): ...


class DatabaseAlreadyExists(StorageError): ...


class TableNotFound(StorageError): ...


class TableAlreadyExists(StorageError): ...


class CommitConflict(StorageError):
    """Another writer changed the table in a way that this commit cannot build on."""


class StatementError(LaminaError):
    """A statement that cannot be parsed or is not allowed."""


class ParseError(StatementError): ...


class UnsupportedStatement(StatementError): ...


class InvalidName(StatementError): ...


class UnsupportedType(StatementError): ...


class UnsupportedConstraint(StatementError): ...


class UnsupportedOption(StatementError): ...


class InvalidKey(StatementError):
    """ORDER BY or PRIMARY KEY: unknown or repeated columns, empty, or not a prefix."""


class InvalidColumns(StatementError):
    """A column list that is empty, repeats a column or names one that the table lacks."""


class InvalidSource(StatementError):
    """Rows to insert of the wrong shape."""


class InvalidValue(StatementError):
    """A value outside its type's domain, or NULL in a column that cannot hold it."""


class DuplicateColumn(StatementError): ...
