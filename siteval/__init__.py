"""Leakage-aware evaluation of binary classifiers on grouped data, on Spark.

Every operator takes DataFrames and returns DataFrames.  ``functions`` holds
column expressions, ``operators`` the table-level work, ``sources`` readers
and sinks, ``plans`` whole analyses and the registered queries.
"""
