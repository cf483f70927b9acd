"""Column expressions: dates, geography and units."""
