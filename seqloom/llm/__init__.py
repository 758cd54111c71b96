"""Operators for training-data pipelines; nothing else in seqloom imports this subpackage."""
