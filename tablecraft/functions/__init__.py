"""Column helpers and distributed ordering."""
