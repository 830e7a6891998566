"""Scalar expressions over text."""
