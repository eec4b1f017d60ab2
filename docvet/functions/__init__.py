"""Column-level functions: fixed values, text cleaning, rule packs, scoring, checks."""
