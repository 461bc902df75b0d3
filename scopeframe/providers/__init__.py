"""Language-model services: requests, ways of asking (strategies), the ladder over them, and presets."""
