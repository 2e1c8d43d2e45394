"""Column functions and folds."""
