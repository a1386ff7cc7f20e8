"""Readers and parsers: feeds, pages, social exports."""
