"""Column expressions: no shuffles, no Python at run time."""
