"""Errors of the engine. Set-wise checks report these names in a violations table."""

from __future__ import annotations


class MemoryError_(Exception):
    """Base of all errors; `kind` is the name that violations tables use."""

    kind = "MemoryError"


class InvalidId(MemoryError_):
    kind = "InvalidId"


class InvalidValue(MemoryError_):
    kind = "InvalidValue"


class InvalidReplay(MemoryError_):
    kind = "InvalidReplay"


class DuplicateEvent(MemoryError_):
    kind = "DuplicateEvent"


class VersionConflict(MemoryError_):
    kind = "VersionConflict"

    def __init__(self, stream: str, expected: int | None, actual: int | None):
        super().__init__(f"stream {stream}: expected version {expected}, found {actual}")
        self.stream, self.expected, self.actual = stream, expected, actual


class MissingEntity(MemoryError_):
    kind = "MissingEntity"


class MissingFact(MemoryError_):
    kind = "MissingFact"


class ConflictingFact(MemoryError_):
    kind = "ConflictingFact"


class BudgetTooSmall(MemoryError_):
    kind = "BudgetTooSmall"

    def __init__(self, required: int, available: int):
        super().__init__(f"seeds need {required} tokens, the budget is {available}")
        self.required, self.available = required, available


class CodecError(MemoryError_):
    kind = "Codec"


class Corruption(MemoryError_):
    kind = "Corruption"


class ExternalModification(MemoryError_):
    kind = "ExternalModification"


class RetrievalFailure(MemoryError_):
    kind = "Retrieval"


class ExtractionFailure(MemoryError_):
    kind = "Extraction"


BY_KIND = {c.kind: c for c in MemoryError_.__subclasses__()}
