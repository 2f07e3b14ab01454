"""Column expressions: value presets and readers of JSON replies."""
