"""Jobs over the change, sighting and run streams."""
