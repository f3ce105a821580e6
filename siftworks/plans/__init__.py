"""Whole runs: discovery, daily digest, weekly plan, polling, reports."""
