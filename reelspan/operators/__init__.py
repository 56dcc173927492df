"""Relational operators over corpora, episodes, scenes and vectors: DataFrame in, DataFrame out."""
