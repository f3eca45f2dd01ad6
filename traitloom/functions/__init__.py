"""Part of traitloom."""
