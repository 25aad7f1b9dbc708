"""Every operator as a runnable query over the given tables, with its SQL twin."""
