"""Strandloom: genome annotation and corpus preparation as Spark dataflows."""

__version__ = "0.1.0"
