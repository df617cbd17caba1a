"""driftmode subpackage."""
