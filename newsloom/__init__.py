"""News and entity intelligence as distributed PySpark jobs."""
