"""Part of quern; see the README for the layout."""
