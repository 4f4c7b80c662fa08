"""Archive scans, synthetic and file sources, sinks."""
