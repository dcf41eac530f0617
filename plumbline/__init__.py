"""Validity audits of labelled, repeated-measures datasets as Spark plans."""
