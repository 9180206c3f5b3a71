"""Sources: files to cells."""
