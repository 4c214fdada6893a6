"""Declarations that plans are built from, and the registered queries."""
