"""Training-data operators: language id, secrets, decontamination, toxicity, language-model
scoring, chat formatting, host rules, source mixing, near-duplicate joins, token output.

Nothing else in the library imports this package.
"""
