"""Adapters from plain tables to articles, and the registered queries with their SQL."""
