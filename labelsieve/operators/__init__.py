"""Operators: scanning, sections, rules, findings, verdicts, lines, history."""
