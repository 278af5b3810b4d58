"""Operators: every public function takes and returns ``DataFrame`` objects."""
