"""Exceptions raised by the engine."""


class EngineError(Exception):
    """Base class of all engine errors."""


class ShapeMismatch(EngineError, ValueError):
    """Inputs do not have compatible sizes."""


class SingularMatrix(EngineError, ArithmeticError):
    """A normal-equation matrix cannot be inverted."""


class OptimizationFailed(EngineError, RuntimeError):
    """An iterative fit did not converge."""


class FormulaError(EngineError, ValueError):
    """A formula cannot be parsed."""


class VariableNotFound(EngineError, KeyError):
    """A named column does not exist."""


class InvalidOperation(EngineError, ValueError):
    """The operation is undefined for the given input."""
