"""Estimation, planning and the SQL dialect."""
