"""Query plans composed of the operators, and their registry."""
