"""Whole jobs, the table bindings, and the registered queries."""
