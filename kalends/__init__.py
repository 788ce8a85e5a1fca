"""kalends: calendar and contact analytics as PySpark DataFrame operators."""
