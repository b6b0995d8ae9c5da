"""Training-data operators at corpus scale. Nothing else in the package imports this folder."""
