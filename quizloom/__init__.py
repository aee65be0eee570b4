"""Batch DataFrame operators for multiple-choice question data on Spark.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame steps) and ``plans`` (whole jobs built from them).
"""

__version__ = "0.1.0"
