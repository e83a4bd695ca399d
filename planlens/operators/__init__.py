"""Relational operators over plans, runs, events and ledgers."""
