"""Operators of a training-data pipeline, each independent of the rest of the library."""
