"""Jobs that put several operators together."""
