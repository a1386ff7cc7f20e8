"""Plumewire: media-monitoring analytics written as Spark DataFrame plans."""
