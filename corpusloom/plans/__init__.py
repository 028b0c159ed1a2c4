"""The registered queries, by section, each with its SQL."""
