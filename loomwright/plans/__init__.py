"""Multi-step plans: specs, catalog, validation, reviews."""
