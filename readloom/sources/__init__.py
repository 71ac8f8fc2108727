"""Sources and sinks of alignment files, their indices and reports."""
