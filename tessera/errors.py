"""Exceptions of the library."""


class TesseraError(Exception):
    """Base of all errors raised here."""


class NotFittedError(TesseraError):
    """The pipeline or step was used before ``fit``."""


class SchemaError(TesseraError):
    """A column or type is not what a step needs."""


class MissingColumnError(SchemaError):
    """A named column does not exist."""

    def __init__(self, column: str, available: list[str]):
        self.column, self.available = column, list(available)
        super().__init__(f"no column {column!r}; there are {', '.join(map(repr, available)) or 'none'}")


class FitError(TesseraError):
    """Learning failed, or a query gave no row."""


class CompilationError(TesseraError):
    """A step's expressions can't be put into a plan."""


class UnseenCategoryError(TesseraError):
    """Values that ``fit`` has not seen."""

    def __init__(self, column: str, categories: list):
        self.column, self.categories = column, list(categories)
        super().__init__(f"column {column!r} has values not seen by fit: {self.categories!r}")


class ClassificationError(TesseraError):
    """A custom step is neither static nor learning in a consistent way."""


class StaticViolationError(TesseraError):
    """A step declared static tried to learn."""


class FrozenError(TesseraError):
    """A frozen pipeline can't be fitted again."""


class InvalidStepError(TesseraError):
    """A pipeline was given something that is no step."""
