"""Listing price analytics and text corpus preparation as composable Spark DataFrame operators."""
