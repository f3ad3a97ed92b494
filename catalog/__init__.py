"""Every operator as a query on the given tables, with its SQL twin."""
