"""Readers and writers for the delimited, JSON-lines, FASTA, archive and markup formats."""
