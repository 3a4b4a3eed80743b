"""Scalar functions: Column expressions and the small numpy routines behind grouped operators."""
