"""Training-data operators: nothing else in ``quire`` imports this subpackage."""
