"""Spend analytics for metered-usage bills, written as Spark DataFrame plans."""
