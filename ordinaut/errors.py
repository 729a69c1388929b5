"""Exceptions of the library."""


class OrdinautError(Exception):
    """Any failure that the library itself reports."""


class InvalidArgument(OrdinautError, ValueError):
    """An argument outside what an operator is defined for."""


class OutOfBounds(OrdinautError, IndexError):
    """An index outside a sequence."""


class NullValue(OrdinautError, ValueError):
    """A sequence with nulls where values are required."""


class BadPartition(OrdinautError, ValueError):
    """A partition that doesn't cover its sequence exactly."""
