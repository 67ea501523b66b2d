"""Derived views, registered queries and their oracles."""
