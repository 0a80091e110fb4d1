"""Column-level building blocks: everything here maps a Column to a Column."""
