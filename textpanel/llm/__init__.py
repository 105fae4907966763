"""Operators for preparing large training collections. Nothing outside this package imports it."""
