"""Training-data operators at corpus scale. Nothing else in docloom imports this subpackage."""
