"""Operators over indexed frames."""
