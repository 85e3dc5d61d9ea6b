"""Whole jobs: the readiness report and the tables derived from it."""
