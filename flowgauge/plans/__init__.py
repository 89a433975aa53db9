"""End-to-end plans composed of the operators, and the query catalogue."""
