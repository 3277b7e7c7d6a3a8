"""Tables, lines and the catalog of indices."""
