"""Scalar functions: Column to Column, and their twins for names held by the driver."""
