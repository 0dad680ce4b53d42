"""Exceptions of the public API."""


class CaminhoError(Exception):
    """Base of all errors raised on purpose."""


class ArgumentError(CaminhoError, ValueError):
    """An argument is outside its contract."""


class ReferenceDataError(CaminhoError):
    """A reference table is missing or cannot be read."""


class OutsideCoverageError(CaminhoError):
    """Points lie outside the area that the register covers."""


class NothingFoundError(CaminhoError):
    """A lookup found nothing at all."""
