"""Whole plans: requests and the pipeline of a region."""
