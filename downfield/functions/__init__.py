"""Column functions: parsing of play texts, names, clock and field position."""
