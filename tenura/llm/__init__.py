"""Operators for preparing training text at cluster scale.

Every operator takes and returns DataFrames; nothing outside this folder imports it.
"""
