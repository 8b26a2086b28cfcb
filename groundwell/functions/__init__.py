"""Column functions: text, vectors, money, and the few pandas UDFs that built-ins cannot express."""
