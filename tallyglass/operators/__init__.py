"""Checks, staging, integration and analytics. DataFrame in, DataFrame out, nothing collected."""
