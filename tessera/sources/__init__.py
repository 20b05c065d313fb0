"""Byte-range sources, locators, and options for writing."""
