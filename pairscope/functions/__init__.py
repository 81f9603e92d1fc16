"""Column functions: text and array kernels."""
