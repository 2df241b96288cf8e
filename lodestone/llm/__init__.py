"""Operators of a training-data pipeline: sharding, mixing, decontamination, toxicity, token files,
token counts, substring dedup, line-frequency quality rules, n-gram scoring, a similarity join, conversation
repair, SentencePiece encoding and decoding, and hard negatives.

Nothing else in the library imports this subpackage.
"""
