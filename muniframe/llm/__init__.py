"""Training-data operators on document tables. Nothing else in the library imports this package."""
