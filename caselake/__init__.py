"""caselake: governed record integration as plain DataFrame jobs."""

__version__ = "0.1.0"
