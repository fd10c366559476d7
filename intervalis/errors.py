"""Exceptions of the library."""


class StoreError(Exception):
    """A request that the store cannot fulfil."""


class DuplicateKeyError(StoreError):
    """An inserted key equals a stored one."""


class MissingKeyError(StoreError):
    """A key to be changed is not stored."""


class NoSuchCollectionError(StoreError):
    """A collection that was never created."""


class NoSuchIndexError(StoreError):
    """An index that was never created."""


class UnsupportedConditionError(StoreError):
    """A condition of a type that the index does not have."""


class CursorClosedError(RuntimeError):
    """A cursor is used after it was closed or timed out."""
