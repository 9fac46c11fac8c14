"""How a program is run: as joins and aggregations, or by the matcher."""
