"""Streams of observations into the vintage store, and windows over them."""
