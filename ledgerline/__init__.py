"""Spark jobs for file ingestion and health-plan lookups.

Every operator takes DataFrames and returns a DataFrame; the plan stays lazy
until the caller writes or shows it.
"""

__version__ = "0.1.0"
