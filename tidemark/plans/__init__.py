"""How the test tables map onto the model, and the registered queries with their SQL."""
