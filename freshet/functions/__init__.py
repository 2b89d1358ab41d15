"""Scalar building blocks: every function maps Columns to a Column."""
