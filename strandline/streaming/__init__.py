"""Operators with state: searchers, selectors, policies, change detection."""
