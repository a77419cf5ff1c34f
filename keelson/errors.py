"""What a store refuses, by name."""


class KeelsonError(Exception):
    """Base of all errors of this library."""


class StoreClosed(KeelsonError):
    """The store was closed before the call."""


class EmptyKey(KeelsonError):
    """A raw key has at least one byte."""


class NotFound(KeelsonError):
    """A strict update met no record."""


class DuplicateKey(KeelsonError):
    """A strict create met a record with the same primary key or unique value."""


class WriteThrottled(KeelsonError):
    """The ingest queue is full, over its memory, or stopped."""


class QueueFull(WriteThrottled):
    """No slot is free."""


class QueueOverMemory(WriteThrottled):
    """The waiting records' bytes exceed the limit."""


class QueueStopped(WriteThrottled):
    """The queue takes nothing any more."""


class ConflictingCommit(KeelsonError):
    """Another writer committed the same version first."""


class DirectoryNotEmpty(KeelsonError):
    """A snapshot goes to a new or empty directory."""


class UnsupportedOperator(KeelsonError):
    """The field's type has no such comparison."""


class UnknownField(KeelsonError):
    """The table has no such field, or it takes no predicate."""


class MalformedKey(KeelsonError):
    """Bytes that are no key of the format."""


class MalformedValue(KeelsonError):
    """Bytes that are no record of the table."""


class SchemaError(KeelsonError):
    """A declaration that makes no table."""
