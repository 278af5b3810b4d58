"""Whole jobs composed from operators: pipeline, insights page, registered queries."""
