"""Part of sightline; see the README for the layout."""
