"""Announcement intelligence on Spark: extraction, classification, identity, merging, delivery and catalogue views."""
