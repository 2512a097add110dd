"""Exceptions of the engine. Each has a fixed message form; DimensionMismatch and its like carry their numbers."""

from __future__ import annotations


class QuarryError(Exception):
    """Base of all errors; `form` is the message with places for the arguments."""

    form = "{0}"

    def __init__(self, *args):
        self.values = args
        super().__init__(self.form.format(*args))


def _kind(name: str, form: str, base: type = QuarryError) -> type:
    return type(name, (base,), {"form": form, "__module__": __name__})


# fixed values: message forms
ParseError = _kind("ParseError", "SQL parse error: {0}")
Unsupported = _kind("Unsupported", "unsupported SQL: {0}")
TableAlreadyExists = _kind("TableAlreadyExists", "table '{0}' already exists")
TableNotFound = _kind("TableNotFound", "table '{0}' does not exist")
IndexAlreadyExists = _kind("IndexAlreadyExists", "index '{0}' already exists")
IndexNotFound = _kind("IndexNotFound", "index '{0}' does not exist")
ColumnNotFound = _kind("ColumnNotFound", "column '{0}' does not exist")
DuplicateColumn = _kind("DuplicateColumn", "column '{0}' appears more than once")
TypeMismatch = _kind("TypeMismatch", "expected {0}, found {1}")
DimensionMismatch = _kind("DimensionMismatch", "vector dimensions differ: left has {0}, right has {1}")
InvalidVectorDimension = _kind("InvalidVectorDimension", "vector dimension must be greater than zero")
VectorDimensionLimit = _kind("VectorDimensionLimit", "vector has {0} dimensions; the maximum is {1}")
NonFiniteVectorElement = _kind("NonFiniteVectorElement", "vector element at index {0} is not finite")
ZeroNorm = _kind("ZeroNorm", "cosine distance is undefined for a zero vector")
NullViolation = _kind("NullViolation", "column '{0}' cannot be null")
UniqueViolation = _kind("UniqueViolation", "duplicate value violates unique constraint on column '{0}'")
InvalidQuery = _kind("InvalidQuery", "invalid query: {0}")
ResultLimitExceeded = _kind("ResultLimitExceeded", "query returns at least {0} rows; maximum is {1}")
LockPoisoned = _kind("LockPoisoned", "database lock was poisoned")
GpuUnavailable = _kind("GpuUnavailable", "GPU compute is unavailable: {0}")
StorageIo = _kind("StorageIo", "storage I/O error: {0}")
StorageBusy = _kind("StorageBusy", "data directory '{0}' is already open by another process")
CorruptSnapshot = _kind("CorruptSnapshot", "corrupt snapshot: {0}")
CorruptWal = _kind("CorruptWal", "corrupt write-ahead log: {0}")


def http_status(error: QuarryError) -> tuple[int, str]:
    """HTTP status and error code."""
    table = [
        ((TableNotFound, ColumnNotFound, IndexNotFound), 404, "not_found"),
        ((TableAlreadyExists, IndexAlreadyExists, UniqueViolation, NullViolation), 409, "constraint_violation"),
        ((ResultLimitExceeded,), 422, "response_too_large"),
        ((LockPoisoned, StorageIo, StorageBusy, CorruptSnapshot, CorruptWal), 500, "internal_error"),
        ((Unsupported,), 501, "unsupported_sql"),
        ((DimensionMismatch,), 400, "dimension_mismatch"),
    ]
    return next(((status, code) for kinds, status, code in table if isinstance(error, kinds)), (400, "invalid_request"))


def from_spark(error: Exception) -> QuarryError | None:
    """The engine's error that a failed Spark job stands for, or None."""
    text = str(error)
    if "ZERO_NORM" in text:
        return ZeroNorm()
    if "NON_FINITE_RESULT" in text:
        return InvalidQuery("numeric result is not finite")
    if "VECTOR_WIDTHS" in text:
        return InvalidQuery("vector dimensions differ")
    if "DIVIDE_BY_ZERO" in text or "REMAINDER_BY_ZERO" in text:
        return InvalidQuery("division by zero")
    if "ARITHMETIC_OVERFLOW" in text or "INTEGER_OVERFLOW" in text or "BINARY_ARITHMETIC_OVERFLOW" in text:
        return InvalidQuery("integer overflow")
    return None
