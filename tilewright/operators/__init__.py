"""Subpackage of tilewright."""
