"""Applications of the fold: archives, document bundles, memories."""
