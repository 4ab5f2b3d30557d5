"""Wiring of operators into the analysis, the query registry and its SQL oracle."""
