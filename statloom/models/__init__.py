"""Models with all learned parameters in the open: fitted from distributed aggregates, applied as projections."""
