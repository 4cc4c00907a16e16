"""Where readings and dimensions come from."""
