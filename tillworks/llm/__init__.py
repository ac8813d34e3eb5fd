"""Operators of a training-data pipeline; each module names its method and its contract."""
