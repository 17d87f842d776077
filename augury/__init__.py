"""Forecast analytics on Spark: features, scoring, pricing, replay and models as DataFrame operators."""
