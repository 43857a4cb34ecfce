"""Sources, sinks and appends."""
