"""tesserae: a PySpark-native engine for structured documents and evidence retrieval."""
