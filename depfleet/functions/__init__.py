"""Part of depfleet."""
