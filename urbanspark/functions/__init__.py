"""Column expressions: geometry, projections, wind formulas, text."""
