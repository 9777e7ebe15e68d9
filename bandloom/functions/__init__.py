"""Scalar functions: band math, indices, colour, stretches."""
