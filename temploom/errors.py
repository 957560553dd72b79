"""Error taxonomy of the package."""


class TemploomError(Exception):
    """Base class."""


class InvalidConfig(TemploomError, ValueError):
    pass


class RegexCompileError(TemploomError, ValueError):
    pass


class StoreError(TemploomError):
    """A catalog store could not be read or written."""


class UnsupportedCatalogVersion(StoreError):
    pass


class CatalogDecodeError(StoreError):
    pass
