"""Composed jobs: templates, view catalog, refresh."""
