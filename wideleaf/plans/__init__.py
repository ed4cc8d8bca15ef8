"""Views over cells."""
