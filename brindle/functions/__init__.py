"""Column functions: token arrays, text scores, tool calls."""
