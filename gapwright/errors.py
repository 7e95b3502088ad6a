"""Errors that callers may catch."""


class GapError(Exception):
    """Base of all errors raised here."""


class GapValueError(GapError, ValueError):
    """An argument or a column has a value that cannot be used."""


class GapTypeError(GapError, TypeError):
    """An argument or a column has a type that cannot be used."""
