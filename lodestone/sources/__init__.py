"""Sources: files, manifests, profiles, benchmarks, and the driver's tables as a corpus."""
