"""A PySpark-native engine for evidence retrieval, structured lookup and document analytics."""
