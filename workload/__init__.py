"""The queries this repository is checked and timed with, and their SQL counterparts."""
