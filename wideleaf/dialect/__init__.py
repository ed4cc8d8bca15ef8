"""The SELECT dialect: text to tree (``lexer``, ``parser``), tree to columns (``binder``, ``functions``, ``aggregates``), and
columns to a DataFrame over cells (``query``)."""

from wideleaf.dialect.query import Catalog, Table, run

__all__ = ["Catalog", "Table", "run"]
