"""Joins, merges, clustering and metric operators over news collections."""
