"""Column expressions: features, exact number formatting, binning."""
