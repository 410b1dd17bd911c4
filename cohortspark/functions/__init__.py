"""Distribution functions and other numeric helpers for small arrays on the driver."""
