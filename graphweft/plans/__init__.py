"""Orchestration on the driver: question answering, the agent, evaluation."""
