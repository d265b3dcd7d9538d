"""Patient-reported outcome analytics on Spark.

Every operator is a function from DataFrame (or Column) to DataFrame (or
Column), built from native Spark SQL expressions and Spark ML.  Nothing in
the library creates a session, collects base rows or converts to pandas.
"""

__version__ = "0.1.0"
