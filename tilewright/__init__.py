"""tilewright: a PySpark-native engine for exact vector, spectral and corpus analytics."""
