"""quartier: area-panel analytics as Spark DataFrame operators."""
