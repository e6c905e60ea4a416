"""Part of termloom: streaming."""
