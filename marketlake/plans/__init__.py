"""Whole tables built from the operators: cleaned data, dimensions, analytic tables, marts, serving results."""
