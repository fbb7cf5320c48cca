"""Whole workflows composed of the operators; each is one logical plan."""
