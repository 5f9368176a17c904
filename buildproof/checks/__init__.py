"""Checks: decisions on the numbers that operators measure."""
