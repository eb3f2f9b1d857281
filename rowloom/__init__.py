"""rowloom: a PySpark-native engine for semi-structured recruitment documents and relational reference data."""
