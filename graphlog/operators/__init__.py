"""Relational operators over graph logs."""
