"""Training-data operators at corpus scale; nothing outside this package imports it."""
