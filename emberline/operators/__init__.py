"""Queries over logical tables: templates, epochs, search, comparison, rates and reports."""
