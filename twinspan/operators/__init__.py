"""Relational, interval and graph operators."""
