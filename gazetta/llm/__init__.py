"""Training-data pipeline operators (self-contained: the rest of the library never imports this)."""
