"""Registered queries: adapters from the test tables to domain tables, one query per operator, SQL twins."""
