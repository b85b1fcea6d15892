"""Part of braidwork: operators."""
