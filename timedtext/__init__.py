"""Timed text at scale: segments of transcripts and translations as DataFrame operators."""
