"""Part of lumenframe."""
