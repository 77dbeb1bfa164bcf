"""Writers and projections."""
