"""Scratch tables and the registry of queries."""
