"""Verification of agent-run records and exact evaluation of predictors, on Spark."""
