"""Part of braidwork: streaming."""
