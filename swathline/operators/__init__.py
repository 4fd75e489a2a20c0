"""Operators over DataFrames: weighted and circular aggregates, histograms, windows, joins, searches and sets."""
