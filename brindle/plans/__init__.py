"""The query-text front end and the rules."""
