"""Textification of arriving files."""
