"""Feeds, pages and listings as DataFrames, and the tables that state is kept in."""
