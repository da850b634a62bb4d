"""Training-data operators over document corpora. Nothing else in the package imports this subpackage."""
