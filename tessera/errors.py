"""Errors, under the builtin classes callers catch: IOError for storage, ValueError for arguments."""


class CellStoreError(Exception):
    pass


class StorageError(CellStoreError, IOError):
    """A statement failed in the engine."""


class TableSetNotFound(CellStoreError, IOError):
    pass


class DatabaseNotFound(CellStoreError, IOError):
    pass


class NoQueryableTables(CellStoreError, IOError):
    pass


class MissingPreconditions(CellStoreError, IOError):
    pass


class SchemaValidationError(CellStoreError, ValueError):
    pass


class UnsupportedResolution(CellStoreError, ValueError):
    pass


class MixedResolutions(CellStoreError, ValueError):
    pass


class NoResolutionsDefined(CellStoreError, ValueError):
    pass


class EmptyCells(CellStoreError, ValueError):
    pass


class InvalidCell(CellStoreError, ValueError):
    pass


class MissingColumn(CellStoreError, ValueError):
    pass


class MissingQueryPlaceholder(CellStoreError, ValueError):
    pass


class Aborted(CellStoreError, KeyboardInterrupt):
    pass
