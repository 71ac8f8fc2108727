"""Column functions and parsers: virtual positions, ranges, flags, statistics."""
