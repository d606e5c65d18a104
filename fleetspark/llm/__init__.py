"""Operators for preparing training text: language, quality, duplicates, secrets, mixing, sharding, packing.

Every operator reads only the columns it names and returns new columns beside the document's key, so extra columns
of any name, clashing ones included, cannot disturb it.
"""
