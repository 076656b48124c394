"""Operators for training-data work; nothing outside this subpackage imports it."""
