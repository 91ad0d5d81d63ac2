"""Sources, sinks and integrity checks."""
