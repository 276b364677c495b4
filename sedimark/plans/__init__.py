"""Registered queries and the SQL that tells their rows."""
