"""riskframe: building and auditing tabular risk scores as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a
``pyspark.ml`` estimator) that Spark partitions and shuffles itself.
"""

__version__ = "0.1.0"
