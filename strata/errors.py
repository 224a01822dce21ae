"""Errors that callers can tell apart."""

from __future__ import annotations


class StrataError(Exception):
    """Any error of this library."""


class UnknownHeader(StrataError):
    """No family has this struct id and version."""


class DuplicateHeader(StrataError):
    """Two declarations share a struct id and version."""


class ShapeMismatch(StrataError):
    """The operation doesn't fit how many live records the family has."""


class NoMigrationPath(StrataError):
    """No chain of migrations leads from one version to the other."""


class PermissionDenied(StrataError):
    """The session's tenant doesn't own the record."""


class ValidationError(StrataError):
    def __init__(self, message: str, field: str | None = None) -> None:
        super().__init__(f"{field}: {message}" if field else message)
        self.field, self.message = field, message


class MalformedPayload(StrataError):
    """Bytes or JSON that don't decode."""


class OutOfRange(StrataError):
    """A part of an id needs more bits than it has."""

    def __init__(self, part: str, value: int, bits: int) -> None:
        super().__init__(f"{part} {value} needs more than {bits} bits")
        self.part, self.value, self.bits = part, value, bits


class StructIdOutOfRange(OutOfRange):
    """More than 20 bits."""


class TenantOutOfRange(OutOfRange):
    """More than 48 bits."""


class ShardOutOfRange(OutOfRange):
    """More than 12 bits."""


class TickOutOfRange(OutOfRange):
    """More than 48 bits."""


class OrphanAlias(StrataError):
    """A secondary anchor names a primary that isn't there."""


class ChecksumMismatch(StrataError):
    """Stored bytes aren't those that were named or summed."""


class PageFull(StrataError):
    """A bounded table has no room for another entry."""


class NotFound(StrataError):
    """Nothing is at the place that was asked for."""


class MigrationFailed(StrataError):
    """A migration's result lacks columns of the layout it should have."""


class Conflict(StrataError):
    """Another writer came first; try again."""


class StorageError(StrataError):
    """Files could not be read or written."""


class Unavailable(StrataError):
    """A node or service didn't answer."""


class Unsupported(StrataError):
    """The operation needs a schema, or isn't offered."""


#: Codes in the reject table.
REJECT_CODES = ("UnknownHeader", "MalformedPayload", "ValidationFailed", "PreprocessFailed", "Storage", "Unsupported")
