"""Training-data operators. Nothing else in lamina imports this subpackage."""
