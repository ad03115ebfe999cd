"""Descant: a PySpark-native engine for media-library and lyric-timing workloads."""
