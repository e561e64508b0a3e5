"""Stratified case/control evaluation of sequence models, on Spark."""
