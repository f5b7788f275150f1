"""Column expressions: clock arithmetic, calendar features, energy ratios, moments."""
