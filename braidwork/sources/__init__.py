"""Part of braidwork: sources."""
