"""Net and solver descriptions, the batch kernels that tasks run, and multi-round plans."""
