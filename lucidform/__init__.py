"""Interpretable-formula analytics on Spark DataFrames."""

from lucidform.sources.labelled import Labelled

__all__ = ["Labelled"]
