"""Column helpers: text tests, JSON codecs, positions, labels."""
