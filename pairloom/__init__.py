"""Linking two versions of an item catalog with Spark."""
