"""tessitura: a Spark-native engine for labelled track catalogues.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregates and windows.  Python code runs
inside tasks only where signal maths needs it (mel features, keyphrase
re-ranking).
"""

__version__ = "0.1.0"
