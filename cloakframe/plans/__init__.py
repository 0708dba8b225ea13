"""Plans that put the operators together, and the catalogue of queries."""
