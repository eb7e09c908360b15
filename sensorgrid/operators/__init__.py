"""Operators over DataFrames of captures."""
