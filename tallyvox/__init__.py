"""Rater agreement, consensus, triage and curation of labelled grids on Spark."""
