"""Readers, normalisers, upserts and stores."""
