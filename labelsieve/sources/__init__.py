"""Input tables, dictionaries, settings and result writers."""
