"""Column functions: text, safety, access rules, filters, units, research rules."""
