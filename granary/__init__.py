"""Spark jobs that turn raw multilingual pages and documents into a measured training corpus."""
