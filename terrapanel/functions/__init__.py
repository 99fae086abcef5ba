"""Column expressions: guarded arithmetic, bins, ranks, moments, seeded order, special functions."""
