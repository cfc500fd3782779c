"""Query plans and the corpus facade."""
