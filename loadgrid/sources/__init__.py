"""Readers that turn files and tables into the long readings table."""
