"""memspark: a PySpark-native engine for typed memory records and their retrieval."""
