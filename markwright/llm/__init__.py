"""Training-data operators for very large corpora. Nothing else in the library imports this subpackage."""
