"""Where notes come from and go to."""
