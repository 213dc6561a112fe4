"""Drought indices and food-price analytics as Spark DataFrame operators."""
