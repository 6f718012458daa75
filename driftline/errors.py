"""Errors of the engine; the names say what went wrong, the base classes fit Python's conventions."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class ClosedError(EngineError, RuntimeError):
    """The engine has been closed."""


class SerializationError(EngineError, ValueError):
    """A record could not be written or read."""


class InvalidTimestampError(EngineError, ValueError):
    """A time is negative, not finite or out of range."""


class InvalidInputError(EngineError, ValueError):
    """An argument breaks a documented rule."""


class ObjectNotFoundError(EngineError, KeyError):
    """A query relative to an object that has no current position."""


class StorageError(EngineError, OSError):
    """Reading or writing files failed."""
