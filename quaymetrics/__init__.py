"""Spark operators for trip panels, vintage series, loan panels, trade panels and experiments."""
