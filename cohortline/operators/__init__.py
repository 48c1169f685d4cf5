"""Operators of cohort analytics."""
