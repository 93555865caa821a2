"""Batch and streaming analytics over collections of AI-chat conversations, expressed as Spark DataFrames."""
