"""Where results and archived readings go."""
