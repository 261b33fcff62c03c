"""Column helpers shared by every stage."""
