"""Column functions: plain expressions, pixel expressions and Arrow image kernels."""
