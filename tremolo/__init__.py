"""Tremolo: event-stream ("spike train") and cohort analytics on Spark DataFrames."""
