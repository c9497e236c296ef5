"""The errors of the engine."""


class EngineError(Exception):
    """Base of all."""


class StorageIO(EngineError):
    """A database that is there already, or that isn't there."""


class SerdeError(EngineError):
    """Text that is no JSON of the kind that is needed."""


class InvalidConfig(EngineError):
    pass


class Corruption(EngineError):
    """A manifest or table that contradicts itself."""


class NotFound(EngineError):
    def __init__(self, id: int):
        super().__init__(f"record {id} not found")
        self.id = id


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class Internal(EngineError):
    pass
