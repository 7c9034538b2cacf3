"""Column expressions. Everything here is native Spark SQL: no Python UDF."""
