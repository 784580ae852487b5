"""Errors of the engine."""


class SketchError(Exception):
    """Bad input, parameters that don't go together, or a sketch that can't be made."""
