"""quarry package."""
