"""Wind and solar scenario analytics as functions from DataFrame to DataFrame."""
