"""Query plans that compose the operators."""
