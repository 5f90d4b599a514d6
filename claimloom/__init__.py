"""Passenger-entitlement analytics as Spark DataFrame operators."""
