"""Operators of a training-data pipeline (decontamination, archives, tokenising,
language-model and toxicity scoring, joins, deduplication, sharding, quality
rules, personal data). Nothing outside this package imports it.

Conventions that hold for every operator here:

* A null or empty text is an empty document; it gets a row, never an error.
* Only the named id and text columns of an input are read, so further columns,
  whatever their names, cannot clash with what an operator computes.
* Empty tables give empty results with the same schema.
* Rows are never merged by id unless the docstring says so; a null id is kept.
"""
