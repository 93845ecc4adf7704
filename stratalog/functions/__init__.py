"""Column functions: hashes, sketches and ordered folds."""
