"""Column functions: canonical forms, dates, check digits, keyed digests and ciphers."""
