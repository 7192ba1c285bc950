"""Landed sources: JSON documents in several layouts, and HTML pages."""
