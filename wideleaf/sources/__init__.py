"""Where cells come from."""
