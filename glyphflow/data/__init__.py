"""Fixed tables: glyph mappings, font patterns, text signatures, language codes."""
