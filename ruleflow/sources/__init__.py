"""File input and output."""
