"""Readers: wide sheets, weather documents, holiday calendars, tables, file fingerprints."""
