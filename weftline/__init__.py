"""weftline: declarative PySpark operators for probe-dataset building, sampling, ordering and scoring."""

__version__ = "0.1.0"
