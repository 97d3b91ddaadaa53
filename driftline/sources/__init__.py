"""Readers and writers. Readers declare their schema; unreadable rows or cells become NULL or are dropped as stated."""
