"""Whole-table operators: plain functions from DataFrames to DataFrames."""
