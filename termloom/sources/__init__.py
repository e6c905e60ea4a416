"""Part of termloom: sources."""
