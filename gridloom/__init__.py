"""gridloom: a PySpark-native engine that turns messy, human-made grids into tidy tables."""
