"""Composed plans and the shared pieces of running them."""
