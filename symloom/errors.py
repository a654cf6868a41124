"""Errors raised by the engine."""


class SymloomError(Exception):
    """Base of all engine errors."""


class StorageError(SymloomError):
    """An index folder cannot be read or written."""


class ParseError(SymloomError):
    """A source text cannot be parsed."""


class UnsupportedExtension(SymloomError):
    """No language is registered for a file extension."""

    def __init__(self, extension: str):
        super().__init__(f"no language claims the extension {extension!r}")
        self.extension = extension


class WatchError(SymloomError):
    """A watch or the daemon failed."""


class ApiError(SymloomError):
    """The HTTP server failed."""


class ProtocolError(SymloomError):
    """A message to the tool server is malformed."""


class UnsupportedSchema(SymloomError):
    """An index was written by a newer version."""

    def __init__(self, found: int, supported: int):
        super().__init__(f"the index has schema version {found}; this version reads up to {supported}")
        self.found, self.supported = found, supported
