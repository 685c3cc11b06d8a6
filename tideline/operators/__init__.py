"""Operators on observations, panels, forecasts and scores; each takes and returns DataFrames."""
