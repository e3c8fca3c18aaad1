"""Operators of a text-corpus pipeline. Nothing outside this folder imports them."""
