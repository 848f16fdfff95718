"""Parlance: conversation analytics and corpus preparation as Spark DataFrame functions."""
