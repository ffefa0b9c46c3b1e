"""Training-data operators: tokens, packing, deduplication, quality, secrets, sharding.

Nothing else in the library imports this subpackage; it builds on the general
helpers of :mod:`tablecheck.session` only.
"""
