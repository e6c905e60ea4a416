"""Part of termloom: operators."""
