"""Predictability statistics of gridded ensembles as Spark DataFrame jobs."""
