"""Training-data operators: ten corpus-scale operators and their registered queries."""
