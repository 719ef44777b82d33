"""Registered queries: each operator applied to whole tables, with the SQL that gives the same rows."""
