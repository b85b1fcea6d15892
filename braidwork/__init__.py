"""Braidwork: network, trajectory and corpus analytics written as Spark plans."""
