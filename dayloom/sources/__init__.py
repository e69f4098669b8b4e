"""Landing, typed scans and sinks."""
