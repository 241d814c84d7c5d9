"""Column functions and driver-side kernels."""
