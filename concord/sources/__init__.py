"""Where data come from, and where reports go."""
