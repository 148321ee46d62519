"""Part of the archspan engine; see README."""
