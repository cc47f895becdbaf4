"""Operators for preparing large text corpora; nothing else in ``kindred`` imports this subpackage."""
