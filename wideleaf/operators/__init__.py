"""Operators over cells: ranges, time, filters, garbage collection, writes."""
