"""A PySpark-native engine for masking personal data in text corpora."""
