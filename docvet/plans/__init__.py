"""Composed plans: research flow, reports, the query catalogue and its SQL oracle."""
