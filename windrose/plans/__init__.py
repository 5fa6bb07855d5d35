"""Views of the driver tables, the query catalog and its SQL."""
