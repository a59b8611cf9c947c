"""Flood-hazard features and risk scoring as Spark DataFrame transformations."""
