"""Relational and model operators over series."""
