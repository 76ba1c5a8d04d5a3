"""Contracts for models and services that are not part of this package."""
