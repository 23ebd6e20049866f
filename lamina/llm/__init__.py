"""Operators of a training-data pipeline: quality, duplicates, licences, languages, tokens, search, chat."""
