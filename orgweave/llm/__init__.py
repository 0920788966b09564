"""Operators of a training-data pipeline: mixing, filtering, scanning, packing, searching and formatting."""
