"""Errors of this package."""


class StrataError(RuntimeError):
    """Anything that this package refuses to do."""


class ConfigurationError(StrataError):
    """A graph, job or name that can't be right, found before any data is read."""


class ResolutionError(ConfigurationError):
    """Inputs that no product, or more than one, satisfies."""
