"""Writers. All of them can be repeated for the same batch without changing the result."""
