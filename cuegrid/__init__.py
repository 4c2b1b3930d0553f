"""Cue grids, sections, moments and clip plans as Spark DataFrame operators."""
