"""Business steps composed of several operators."""
