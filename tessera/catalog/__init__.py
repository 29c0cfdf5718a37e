"""Registered queries by theme; importing a module registers its queries."""
