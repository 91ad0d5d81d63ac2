"""Registered queries, their table bindings and SQL oracles, and end-to-end jobs."""
