"""Whole analyses, composed of the operators."""
