"""Errors: one sentence that says what is wrong, and what to do about it."""


class PlumbError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(PlumbError):
    """The project file is missing or wrong."""


class SourceError(PlumbError):
    """A source or target could not be read or written."""


class PushRefused(PlumbError):
    """A push target is not on the allow-list."""


class SchemaMismatch(PlumbError):
    """Columns differ from what was declared."""


class SemanticsError(PlumbError):
    """A model definition or a request against it is wrong."""
