"""Lodestone subpackage."""
