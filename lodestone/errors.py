"""Errors, one class for each thing a caller may want to handle on its own."""


class LodestoneError(Exception):
    """Base of all."""


class ConfigError(LodestoneError):
    """A setting that can't work."""


class SourceError(LodestoneError):
    """A source that can't be opened or read."""


class SchemaError(LodestoneError):
    """A table or column that doesn't exist."""


class UnsafeQueryError(LodestoneError):
    """A statement that isn't a plain read."""


class PlanError(LodestoneError):
    """A question that can't be turned into a query."""


class IndexError_(LodestoneError):
    """An index that is missing, damaged or of another shape."""


class BudgetExceededError(LodestoneError):
    """Nothing fits a token budget."""


class CitationError(LodestoneError):
    """An answer without evidence."""
