"""Operators of a training-data pipeline: text, token, archive and vector work over document tables."""
