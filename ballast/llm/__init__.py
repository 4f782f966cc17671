"""Operators of a training-data pipeline.

Every operator takes DataFrames and returns the input's columns plus its own, unless it names the columns it returns.
Where an input column has the name of one of the operator's columns, the operator's replaces it. A null text is an
empty text. Rows with equal ids are separate rows unless an operator says otherwise. Empty tables give empty results of
the same schema.
"""
