"""Training-data operators: language id, dedup, packing, token files, quality.

Nothing outside this folder imports it; removing the folder leaves the rest of
the library whole.
"""
