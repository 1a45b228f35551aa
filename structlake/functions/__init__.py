"""Column functions: compositions, units, cutoffs, labels, cells."""
