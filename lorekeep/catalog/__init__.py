"""Registered queries by group: each module's QUERIES maps a name to (function, SQL or None)."""
