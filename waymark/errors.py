"""Errors that callers can tell apart."""


class WaymarkError(Exception):
    """Base class."""


class InvalidIndexError(WaymarkError):
    """The named index doesn't exist, isn't complete, or its path isn't allowed."""


class GeocodeError(WaymarkError):
    """The request can't be matched as asked."""


class SourceError(WaymarkError):
    """A file of a kind that can't be loaded."""
