"""Inputs shared by the tests."""

LONG = ("Lorem ipsum dolor sit amet consectetur " * 6000).strip()
#: Columns a user's table may bring along, named like those the operators use inside.
CLASHING = ("id", "_key", "_row", "_text", "_found", "name", "weight", "size", "rep", "n", "family", "template", "leaf", "rank")
