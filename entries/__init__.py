"""Registered queries and the SQL each of them is compared with."""
