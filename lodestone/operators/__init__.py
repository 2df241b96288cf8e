"""Index building, search, facets, correction, suggestions and reports as DataFrame plans."""
