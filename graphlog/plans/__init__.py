"""Plan helpers: stored intermediates and numbering."""
