"""Column functions: sequence strings, token arrays, draws, vectors."""
