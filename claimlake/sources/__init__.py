"""Scans and table contracts."""
