"""The errors that users can catch."""


class VaricompError(Exception):
    pass


class SpecificationError(VaricompError, ValueError):
    """The data do not fit the model."""


class FormulaError(SpecificationError):
    """The formula is outside the grammar."""


class NumericalError(VaricompError, ArithmeticError):
    pass


class ConvergenceError(NumericalError):
    pass


class ResourceLimitError(VaricompError):
    pass


class IncompleteError(VaricompError):
    """Simulations are missing, or too many failed."""


class LedgerError(VaricompError):
    """Records of another job, or a job that another process works on."""


class PredictionError(VaricompError, ValueError):
    pass


class ArtifactError(VaricompError):
    pass
