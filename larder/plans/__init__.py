"""Compositions and registered queries."""
