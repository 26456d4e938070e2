"""Errors of parsing and optimizing."""


class ParsingException(Exception):
    """A statement that can't be parsed or resolved."""


class OptimizationException(Exception):
    """A plan that can't be optimized."""
