"""Scalar functions as Column expressions: they run inside generated code, without Python on the executors."""
