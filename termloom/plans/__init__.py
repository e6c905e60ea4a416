"""Part of termloom: plans."""
