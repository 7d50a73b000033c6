"""Training-data operators on Spark: near-duplicate search, decontamination, packing, filters.

Nothing outside this folder imports it; the rest of the library works without it.
"""
