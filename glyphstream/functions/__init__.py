"""Part of glyphstream."""
