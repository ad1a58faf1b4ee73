"""Errors that the engine raises itself."""


class EngineError(Exception):
    """Base of the engine's own errors."""


class InvalidParameter(EngineError, ValueError):
    """A worker, shard or position count that no plan can be made for."""


class LengthMismatch(EngineError, ValueError):
    """Two positional inputs of different lengths."""


class StartFailed(EngineError, RuntimeError):
    """A session that couldn't be started or has been stopped."""


class UnsupportedPlatform(EngineError, NotImplementedError):
    """Something that the session's cluster can't do."""


class OutOfBounds(EngineError, IndexError):
    """A position outside the vector."""
