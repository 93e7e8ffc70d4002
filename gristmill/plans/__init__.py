"""Whole imports: the state machine and the session that drives it."""
