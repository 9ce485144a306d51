"""Errors of this package."""


class NetworkError(Exception):
    """Base of all errors of this package."""


class SelectorError(NetworkError, ValueError):
    """A selector that cannot be read or selects nothing where something is needed."""


class TopologyError(NetworkError):
    """Topology or run parameters that are incomplete or contradict each other."""


class ScaleError(NetworkError):
    """Coordinates whose unit cannot be told."""
