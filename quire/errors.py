"""What may go wrong, as exceptions of their own."""


class QuireError(Exception):
    """Any error of this library."""


class UnsupportedFile(QuireError):
    """No source takes files of this kind."""


class EngineNotAvailable(QuireError):
    """A recognition, translation or PDF engine isn't installed."""


class Cancelled(QuireError):
    """The job was cancelled."""


class Conflict(QuireError):
    """Another writer was first."""
