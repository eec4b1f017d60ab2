"""Readers and writers (A1-A11) and the test-table projections."""
