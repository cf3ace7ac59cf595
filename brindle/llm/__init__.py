"""Operators for training-data pipelines; nothing else in brindle imports this subpackage."""
