"""Operators on vectors, values and texts for training data. Nothing outside this folder imports it."""
