"""The catalogue of registered queries."""
