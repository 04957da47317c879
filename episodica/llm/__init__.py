"""Operators for training corpora: deduplication, decontamination, labels and tokens. Nothing else imports this package."""
