"""careflow: patient-flow analytics on Spark.

Operators are functions from DataFrames to DataFrames (``careflow.operators``,
``careflow.functions``, ``careflow.sources``), with Structured Streaming forms
in ``careflow.streaming`` and the registered query catalog in
``careflow.plans``.
"""

__version__ = "0.1.0"
