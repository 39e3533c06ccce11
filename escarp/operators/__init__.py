"""Stages of the batch pipeline."""
