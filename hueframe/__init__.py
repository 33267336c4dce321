"""Colour-lattice analytics as Spark DataFrame operators."""
