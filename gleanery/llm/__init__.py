"""Operators that prepare text for the training of language models. Nothing outside imports this."""
