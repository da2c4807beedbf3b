"""Readers, sinks and the layer inventory."""
