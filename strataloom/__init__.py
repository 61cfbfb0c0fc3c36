"""A PySpark-native engine for knowledge bases of code and documents."""
