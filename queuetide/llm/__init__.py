"""Operators for building training corpora, one module each; nothing else imports them."""
