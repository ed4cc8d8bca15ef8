"""The change log."""
