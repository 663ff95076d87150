"""Stages and operators: each takes DataFrames and gives DataFrames."""
