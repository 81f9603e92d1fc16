"""Sources, sinks and bindings to the driver tables."""
