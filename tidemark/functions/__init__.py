"""Scalar functions as SQL expressions; both engines read the same text."""
