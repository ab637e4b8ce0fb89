"""Time-series operators over keyed observations, as PySpark plans.

Every operator is a function from DataFrames to a DataFrame. Nothing here
triggers a job unless its docstring says so.
"""

__version__ = "0.1.0"
