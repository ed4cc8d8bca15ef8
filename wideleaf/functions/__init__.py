"""Scalar functions and aggregates with the dialect's semantics, as Column builders."""
