"""End-to-end jobs and registered queries."""
