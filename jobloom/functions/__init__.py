"""Scalar building blocks: every public function takes and returns a ``Column``."""
