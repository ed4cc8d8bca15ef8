"""Analytics over sparse wide-column tables, as Spark DataFrame plans."""
