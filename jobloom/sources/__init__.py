"""Readers, writers and the per-board source profiles."""
