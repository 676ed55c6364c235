"""Whole jobs composed from the operators, and the panel they run on in tests."""
