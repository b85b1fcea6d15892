"""Part of braidwork: plans."""
