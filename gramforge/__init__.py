"""gramforge: a PySpark-native econometrics and data-processing engine."""

__version__ = "0.1.0"
