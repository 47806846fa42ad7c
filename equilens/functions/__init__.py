"""Column expressions and distribution kernels."""
