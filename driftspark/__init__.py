"""A PySpark-native engine for labelled transaction streams under concept drift."""
