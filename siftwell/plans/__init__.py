"""How operators are put together into a profile of a table or a dataset."""
