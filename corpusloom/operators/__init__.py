"""DataFrame operators over captures, the page store, candidates and dependencies."""
