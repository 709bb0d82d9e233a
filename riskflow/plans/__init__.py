"""Composed plans: the panel pipeline and the registered query set."""
