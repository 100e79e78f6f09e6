"""Subpackage of varloom."""
