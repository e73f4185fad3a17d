"""Spark-first retrieval, selection and corpus analytics.

Sub-packages are imported on demand; importing this package starts nothing.
"""

__version__ = "0.1.0"
