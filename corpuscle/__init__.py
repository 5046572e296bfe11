"""A Spark engine for the forensics of labelled text tables."""
