"""Reports, each a DataFrame, and the driver's queries."""
