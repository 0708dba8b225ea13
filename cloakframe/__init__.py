"""cloakframe: find sensitive values in text, replace them with stable placeholders, and restore them, on Spark."""
