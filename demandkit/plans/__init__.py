"""Composed jobs and the registered queries over the test tables."""
