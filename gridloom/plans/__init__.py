"""Plans: operators in the order in which a messy table becomes a tidy one."""
