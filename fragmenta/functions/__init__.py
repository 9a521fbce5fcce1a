"""Pure functions: column builders and numpy kernels."""
