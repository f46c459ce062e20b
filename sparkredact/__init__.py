"""Finding and redacting personal data in DataFrames of text."""
