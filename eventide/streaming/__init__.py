"""The same results kept up to date over streams."""
