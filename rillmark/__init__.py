"""rillmark: detection analytics as plain PySpark jobs."""
