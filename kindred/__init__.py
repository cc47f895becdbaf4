"""Pedigree and genotype analytics as DataFrames, with a subpackage for training-corpus operators."""
